"""Risk-set matching inside one longitudinal cohort: members become cases at their event and are controls until then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.distance import DistanceConfig
from pairwell.operators.acceptance import TAKEN
from pairwell.operators.candidates import candidate_edges, group_key
from pairwell.operators.constraints import DEFAULT_RISK_SET, Constraint, RiskSetPolicy, Side
from pairwell.operators.matching import Outcome, Strategy, Support, nearest_birth_date, rule_of, select_pairs, served as served_pairs
from pairwell.operators.serving import least
from pairwell.plans.spec import CommonSupport, MatchingCriteria, RatioPolicy, Reason, TransitionOptions
from pairwell.sources.cohort import CohortSchema, cohort


def common_support(cases: DataFrame, everyone: DataFrame, policy: CommonSupport) -> tuple[Support, DataFrame, DataFrame] | None:
    """(bounds, cases within, cohort within) for cohorts with __x, or None if the scores do not overlap.

    The candidates' bounds are those of the whole cohort, cases included. Members without a finite score are
    outside.
    """
    bounds = []
    for side in (cases, everyone):
        low, high = side.agg(F.min("__x"), F.max("__x")).first()
        if low is None:
            return None
        bounds.append((low, high))
    overlap = max(b[0] for b in bounds), min(b[1] for b in bounds)
    if overlap[0] > overlap[1]:
        return None
    inside = F.coalesce(F.col("__x").between(*overlap), F.lit(False))
    trims = (CommonSupport.TREATED, CommonSupport.BOTH), (CommonSupport.CONTROL, CommonSupport.BOTH)
    trimmed = [side.where(~inside).count() if policy in when else 0 for side, when in zip((cases, everyone), trims, strict=True)]
    kept = [side.where(inside) if policy in when else side for side, when in zip((cases, everyone), trims, strict=True)]
    return Support(policy.value, *bounds, overlap, *trimmed), *kept


def match_transition(
    members: DataFrame,
    schema: CohortSchema,
    criteria: MatchingCriteria = MatchingCriteria(),
    options: TransitionOptions = TransitionOptions(),
    strategy: Strategy = nearest_birth_date,
    config: DistanceConfig | None = None,
    constraints: Sequence[Constraint] = (),
    risk_set: RiskSetPolicy = DEFAULT_RISK_SET,
) -> Outcome:
    """Match each eligible case, in order of event date and id, with members at risk at its event.

    Used members and unique values are used up for the whole cohort. Common support needs a score config and
    trims by its policy; without one, or without overlap, the outcome has no pairs and names the reason.
    """
    keys = list(criteria.required_strata)
    everyone = cohort(members, schema, keys, criteria.unique_by_key).withColumn("__grp", group_key(len(keys)))
    cases = everyone.where(F.coalesce(risk_set.is_case_eligible(F.col, options.age_limit.value), F.lit(False)))
    cases = cases.withColumn("__ord", F.col("__event"))
    policy = RatioPolicy.of(max(criteria.ratio, 1), options.ratio_fallback)

    def refused(category: str, name: str, evaluated: int) -> Outcome:
        none = candidate_edges(cases, everyone, criteria.with_(birth_window_days=0)).where("false")
        return Outcome(lambda: none.select(*TAKEN), cases, everyone, none, criteria, policy, config, True, invalid=Reason(category, name), notes={"evaluated": evaluated})

    scored = config is not None and config.kind == "propensity" and config.accessor is None
    if config is not None and criteria.common_support and not scored:
        return refused("common_support_failure", "requires_propensity_score_map", everyone.count())
    if criteria.invalid_reason():
        return refused("invalid_criteria", criteria.invalid_reason(), everyone.count())
    if criteria.common_support and not scored:
        return refused("common_support_failure", "requires_propensity_score_map", cases.count())

    served, at_risk, support = cases, everyone, None
    if criteria.common_support:
        found = common_support(config.attach(cases), config.attach(everyone), criteria.common_support)
        if found is None:
            return refused("common_support_failure", "no_overlap", cases.count())
        support, served, _ = found
        served = served.drop("__x", "__bad")
        if criteria.common_support is not CommonSupport.TREATED:
            low, high = support.overlap
            at_risk = config.attach(everyone).withColumn("__inside", F.coalesce(F.col("__x").between(low, high), F.lit(False))).drop("__x", "__bad")
    trims = "__inside" in at_risk.columns

    def risk(a: Side, c: Side):
        ok = risk_set.is_at_risk(a, c)
        return ok & c("__inside") if trims else ok

    edges = candidate_edges(served, at_risk, criteria, config, constraints, risk)
    shared = bool(criteria.unique_by_key)

    rule = rule_of(strategy, criteria, policy, config)
    ends = [F.col("__event"), *[k.until(F.col) for k in constraints if k.until]]
    times = all(t in ("date", "timestamp", "timestamp_ntz") for _, t in everyone.select(*ends).dtypes)
    if risk_set != DEFAULT_RISK_SET or len(ends) <= len(constraints) or not times:
        rule = None  # conditions of a run's own are tested pair by pair

    def select() -> DataFrame:
        if rule:
            at, until = (F.unix_micros(x.cast("timestamp")) for x in (F.col("__event"), least(ends)))
            pool = at_risk.where("__inside") if trims else at_risk
            got = served_pairs(served, pool, criteria, rule, config, F.lit(""), shared, at, until)
            if got is not None:
                return got
        return select_pairs(edges, served, criteria, policy, strategy(), F.lit(""), shared)

    return Outcome(select, served, at_risk, edges, criteria, policy, config, True, support, risk=risk, notes={"constraints": list(constraints)})
