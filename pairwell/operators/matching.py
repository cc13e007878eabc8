"""Matching of anchors to candidates: greedy in anchor order, with or without replacement."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions.distance import DistanceConfig
from pairwell.operators import diagnostics, weights
from pairwell.operators.acceptance import TAKEN, chosen, deferred_acceptance, serial_pass
from pairwell.operators.candidates import candidate_edges, eligible, group_key
from pairwell.operators.constraints import Constraint
from pairwell.operators.serving import IN_ORDER, NEAREST, RANDOM, Rule, nearest_reused, serve
from pairwell.plans.spec import Estimand, MatchingCriteria, MatchRatio, RatioPolicy, Reason
from pairwell.sources.cohort import CohortSchema, cohort
from pairwell.sources.staging import written

Strategy = Callable[[], list[Column]]


def nearest_birth_date() -> list[Column]:
    return [F.col("days"), F.col("c_id"), F.col("c_ord")]


def in_order() -> list[Column]:
    return [F.col("c_ord"), F.col("c_id")]


def random_order(seed: int) -> Strategy:
    """By the MD5 of seed, anchor and candidate: the same draw for the same seed on every run and engine."""

    def drawn() -> list[Column]:
        return [F.md5(F.concat_ws(":", F.lit(str(seed)), "a_id", "c_id")), F.col("c_id")]

    drawn.seed = str(seed)
    return drawn


@dataclass(frozen=True)
class Support:
    """Common support of scores, as applied."""

    policy: str
    anchor_bounds: tuple[float, float]
    candidate_bounds: tuple[float, float]
    overlap: tuple[float, float]
    trimmed_anchors: int
    trimmed_candidates: int


@dataclass(frozen=True)
class Outcome:
    """What a run matched, and what its diagnostics are made of.

    anchors and candidates are cohorts (anchors without those that support trimmed); edges is the pool with what
    excludes each pair; selected(grp, a_ord, a_id, c_id, c_unique, days, distance) is computed when first asked
    for and then kept as a table.
    """

    select: Callable[[], DataFrame]
    anchors: DataFrame
    candidates: DataFrame
    edges: DataFrame
    criteria: MatchingCriteria
    policy: RatioPolicy
    config: DistanceConfig | None = None
    transition: bool = False
    support: Support | None = None
    invalid: Reason | None = None
    risk: Callable | None = None
    notes: dict = field(default_factory=dict)

    @cached_property
    def selected(self) -> DataFrame:
        return written(self.select(), "selected")

    @cached_property
    def pairs(self) -> DataFrame:
        """(grp, anchor_id, candidate_id, days, distance)."""
        return self.selected.select("grp", F.col("a_id").alias("anchor_id"), F.col("c_id").alias("candidate_id"), "days", "distance")

    @cached_property
    def diagnostics(self) -> diagnostics.MatchDiagnostics:
        return diagnostics.diagnose(self)

    def summary(self) -> DataFrame:
        """One row of what the run came to."""
        return self.diagnostics.table(self.edges.sparkSession)

    def exclusions(self) -> DataFrame:
        """(category, reason, n, place): pairs of the pool by what excluded them first, in the order of reports."""
        return diagnostics.exclusions(self)

    def with_estimand(self, estimand: Estimand) -> Outcome:
        return replace(self, criteria=self.criteria.with_(estimand=estimand))

    def pair_weights(self, estimand: Estimand | None = None) -> DataFrame:
        """Weights of pairs for an estimand; that which the run realized if none is given."""
        return weights.pair_weights(self.pairs, estimand or self.diagnostics.realized_estimand)

    def match_weights(self, estimand: Estimand | None = None) -> DataFrame:
        return weights.match_weights(self.pairs, estimand or self.diagnostics.realized_estimand)

    def unit_weight_table(self, estimand: Estimand | None = None, sampling: DataFrame | None = None) -> DataFrame:
        """Match, sampling and analysis weights of units, by unit and role."""
        return weights.unit_table(self.match_weights(estimand), sampling).orderBy("unit_id", "role")


def resource(criteria: MatchingCriteria, scope: Column) -> Column:
    """What a match uses up: the unique value within its scope, else the candidate; null: nothing."""
    own = F.lit(None).cast("string") if criteria.allow_replacement else F.concat(F.lit("c:"), F.col("c_id"))
    if not criteria.unique_by_key:
        return own
    return F.coalesce(F.concat(F.lit("u:"), scope, F.lit(":"), F.col("c_unique")), own)


def rule_of(strategy: Strategy, criteria: MatchingCriteria, policy: RatioPolicy, config: DistanceConfig | None) -> Rule | None:
    """How records are served without edges, if the order is one of the three above and the pool a band of days or scores."""
    seed = getattr(strategy, "seed", None)
    order = RANDOM if seed is not None else {nearest_birth_date: NEAREST, in_order: IN_ORDER}.get(strategy)
    if order is None or (config is not None and (config.caliper is None or config.kind not in ("date", "propensity"))):
        return None
    width = max(criteria.birth_window_days, 0) if config is None else config.caliper.value
    return Rule(order, float(width), policy, config is not None and config.kind == "propensity", seed or "")


def served(anchors: DataFrame, candidates: DataFrame, criteria: MatchingCriteria, rule: Rule, config: DistanceConfig | None, scope: Column, together: bool, at: Column | None = None, until: Column | None = None) -> DataFrame | None:
    """The greedy pass over records, or None where each anchor's choice is its own and needs edges."""
    if criteria.allow_replacement and not criteria.unique_by_key:
        return nearest_reused(anchors, candidates, rule) if rule.order == NEAREST and not rule.scored and until is None else None
    if rule.scored:
        anchors, candidates = config.attach(anchors), config.attach(candidates)
    return serve(anchors, candidates, rule, resource(criteria, scope), together, at, until)


def select_pairs(edges: DataFrame, anchors: DataFrame, criteria: MatchingCriteria, policy: RatioPolicy, order: list[Column], scope: Column, together: bool) -> DataFrame:
    """The greedy pass over edges, in whichever way the criteria allow."""
    able = eligible(edges).withColumn("resource", resource(criteria, scope))
    if criteria.allow_replacement and not criteria.unique_by_key:
        return chosen(able, policy, order)
    if policy.strict:
        who = anchors.select(F.col("__ord").alias("a_ord"), F.col("__id").alias("a_id"))
        return serial_pass(able, who, policy, order, together)
    return deferred_acceptance(able, policy, order)


def match_standard(
    anchors: DataFrame,
    candidates: DataFrame,
    schema: CohortSchema,
    criteria: MatchingCriteria = MatchingCriteria(),
    strategy: Strategy = nearest_birth_date,
    fallback: Sequence[MatchRatio] = (),
    config: DistanceConfig | None = None,
    constraints: Sequence[Constraint] = (),
) -> Outcome:
    """Match each anchor with up to ratio candidates of its strata within the window or the caliper.

    Invalid criteria give an outcome without pairs that names the reason. A common support policy is reported
    but trims nobody here. Ids are unique on each side.
    """
    keys = list(criteria.required_strata)
    sides = [cohort(x, schema, keys, criteria.unique_by_key).withColumn("__grp", group_key(len(keys))) for x in (anchors, candidates)]
    invalid = criteria.invalid_reason()
    policy = RatioPolicy.of(max(criteria.ratio, 1), fallback)
    edges = candidate_edges(*sides, criteria.with_(birth_window_days=max(criteria.birth_window_days, 0)), config, constraints)
    if invalid:
        refused = edges.where("false")
        return Outcome(lambda: refused.select(*TAKEN), *sides, refused, criteria, policy, config, invalid=Reason("invalid_criteria", invalid))
    rule = None if constraints else rule_of(strategy, criteria, policy, config)

    def select() -> DataFrame:
        got = served(*sides, criteria, rule, config, F.col("grp"), False) if rule else None
        return select_pairs(edges, sides[0], criteria, policy, strategy(), F.col("grp"), False) if got is None else got

    window = {} if config or constraints else {"window": max(criteria.birth_window_days, 0)}
    return Outcome(select, *sides, edges, criteria, policy, config, notes=window)
