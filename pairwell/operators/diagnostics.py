"""Diagnostics of a run: counts of anchors and exclusions, and whether the estimand drifted."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions.running import running_counts
from pairwell.operators.constraints import first_blocking, side
from pairwell.operators.serving import dominated
from pairwell.plans.spec import DRIFT_REASONS, Estimand, Reason
from pairwell.sources.staging import written

if TYPE_CHECKING:
    from pairwell.operators.matching import Outcome

USED, SELF, STRATA, UNIQUE = "used_control_replacement_disabled", "self_match", "strata_mismatch", "unique_key_reused"


@dataclass(frozen=True)
class MatchDiagnostics:
    """Counts of one run, or of several merged."""

    total_anchors_evaluated: int = 0
    anchors_with_no_candidates: int = 0
    anchors_below_required_ratio: int = 0
    matched_anchors: int = 0
    unmatched_anchors: int = 0
    pairs_selected: int = 0
    used_controls: int = 0
    requested_estimand: Estimand = Estimand.ATT
    realized_estimand: Estimand = Estimand.ATT
    drift_reasons: tuple[str, ...] = ()
    trimmed_anchors: int = 0
    trimmed_candidates: int = 0
    support_policy: str | None = None
    support_overlap: tuple[float, float] | None = None
    anchor_bounds: tuple[float, float] | None = None
    candidate_bounds: tuple[float, float] | None = None
    #: Runs that were refused name why; counts of excluded pairs are a table of their own (Outcome.exclusions).
    refused: Mapping[str, int] = field(default_factory=dict)

    @property
    def avg_controls_per_case(self) -> float:
        return self.pairs_selected / self.matched_anchors if self.matched_anchors else 0.0

    def merge(self, other: MatchDiagnostics) -> MatchDiagnostics:
        """Counts are added and drift reasons united; the rest stays as it is here."""
        counts = ("total_anchors_evaluated", "anchors_with_no_candidates", "anchors_below_required_ratio", "matched_anchors", "unmatched_anchors", "pairs_selected", "used_controls", "trimmed_anchors", "trimmed_candidates")
        sums = {k: getattr(self, k) + getattr(other, k) for k in counts}
        more = tuple(r for r in other.drift_reasons if r not in self.drift_reasons)
        refused = {k: self.refused.get(k, 0) + other.refused.get(k, 0) for k in {**self.refused, **other.refused}}
        return replace(self, **sums, drift_reasons=self.drift_reasons + more, refused=refused)

    def table(self, spark: SparkSession) -> DataFrame:
        row = {k: v for k, v in asdict(self).items() if k != "refused"} | {"avg_controls_per_case": float(self.avg_controls_per_case)}
        row |= {"requested_estimand": self.requested_estimand.value, "realized_estimand": self.realized_estimand.value, "drift_reasons": ",".join(self.drift_reasons)}
        for name in ("support_overlap", "anchor_bounds", "candidate_bounds"):
            low, high = row.pop(name) or (None, None)
            row |= {f"{name}_low": low, f"{name}_high": high}
        kinds = {"requested_estimand": "string", "realized_estimand": "string", "drift_reasons": "string", "support_policy": "string", "avg_controls_per_case": "double"}
        ddl = ", ".join(f"{k} {kinds.get(k, 'double' if k.endswith(('_low', '_high')) else 'long')}" for k in row)
        return spark.createDataFrame([tuple(row.values())], ddl)


def _holders(outcome: Outcome, resource: Column) -> DataFrame:
    """The earliest anchor that has each resource."""
    return outcome.selected.select(resource.alias("__r"), F.struct("a_ord", "a_id").alias("__h")).where("__r is not null").groupBy("__r").agg(F.min("__h").alias("__h"))


def _scope(outcome: Outcome) -> Column:
    """Unique values are used up within a stratum, or in the whole cohort."""
    own = F.lit("") if outcome.transition else F.col("grp")
    return F.concat(own, F.lit(":"), F.col("c_unique"))


def classified(outcome: Outcome, edges: DataFrame) -> DataFrame:
    """edges with category and name of what excludes each first at its anchor's turn; null if nothing does."""
    me = F.struct("a_ord", "a_id")
    out = edges.withColumns({"__used": F.lit(False), "__reused": F.lit(False)})
    if not outcome.criteria.allow_replacement:
        held = _holders(outcome, F.col("c_id"))
        out = out.join(held, F.col("c_id") == F.col("__r"), "left").withColumn("__used", F.coalesce(F.col("__h") < me, F.lit(False))).drop("__r", "__h")
    if outcome.criteria.unique_by_key:
        held = _holders(outcome, _scope(outcome))
        out = out.join(held, _scope(outcome) == F.col("__r"), "left").withColumn("__reused", F.coalesce(F.col("__h") < me, F.lit(False))).drop("__r", "__h")
    name = F.when(F.col("__used"), USED).when(F.col("is_self"), SELF).when(F.col("__reused"), UNIQUE).otherwise(F.col("reason"))
    return out.withColumns({"name": F.when(~F.col("filtered"), name), "category": F.when(F.col("filtered"), "additional_filter").when(name.isNotNull(), "constraint")})


def diagnose(outcome: Outcome) -> MatchDiagnostics:
    """The run's counts. Each is an aggregate of its own; nothing but they comes to the driver."""
    asked, criteria = outcome.criteria.estimand, outcome.criteria
    support = outcome.support
    base = MatchDiagnostics(requested_estimand=asked, realized_estimand=asked, support_policy=criteria.common_support.value if criteria.common_support else None)
    total = outcome.notes.get("evaluated")
    anchors = outcome.anchors.count() if total is None else total
    if outcome.invalid:
        # a refused run reports the defaults
        return MatchDiagnostics(total_anchors_evaluated=anchors, unmatched_anchors=anchors, refused={str(outcome.invalid): 1})
    if support:
        base = replace(base, trimmed_anchors=support.trimmed_anchors, trimmed_candidates=support.trimmed_candidates, support_overlap=support.overlap, anchor_bounds=support.anchor_bounds, candidate_bounds=support.candidate_bounds)
    per = outcome.selected.groupBy("a_ord", "a_id").agg(F.count(F.lit(1)).alias("n"))
    short = F.col("n") < outcome.policy.steps[0]
    got = per.agg(F.count(F.lit(1)).alias("matched"), F.sum("n").alias("pairs"), F.count_if(short).alias("short")).first()
    matched, pairs = got.matched, got.pairs or 0
    unmatched = anchors - matched
    if outcome.policy.strict:
        left = outcome.anchors.select(F.col("__ord").alias("a_ord"), F.col("__id").alias("a_id")).join(per, ["a_ord", "a_id"], "left_anti")
        free = classified(outcome, outcome.edges.join(left, ["a_ord", "a_id"], "left_semi")).where("category is null")
        below = free.select("a_ord", "a_id").distinct().count()
        none = unmatched - below
    else:
        below, none = got.short, unmatched
    reusing = criteria.allow_replacement and not criteria.unique_by_key and not outcome.transition
    used = 0 if criteria.allow_replacement else outcome.selected.select("c_id").distinct().count()
    # with replacement, anchors that reach the selection count once more, and others are not missed
    evaluated, missed = (anchors + matched, 0) if reusing else (anchors + base.trimmed_anchors, unmatched)
    trimmed = base.trimmed_anchors + base.trimmed_candidates > 0
    caliper = _undefined_anchors(outcome) > 0
    drifted = (trimmed, missed > 0, below > 0, caliper, caliper and trimmed)
    reasons = tuple(r for r, yes in zip(DRIFT_REASONS, drifted, strict=True) if yes)
    return replace(
        base, total_anchors_evaluated=evaluated, anchors_with_no_candidates=none, anchors_below_required_ratio=below, matched_anchors=matched, unmatched_anchors=missed,
        pairs_selected=pairs, used_controls=used, drift_reasons=reasons, realized_estimand=Estimand.ATM if reasons else asked,
    )


def _undefined_anchors(outcome: Outcome) -> int:
    """Anchors whose score is there but not finite; under a caliper they lose all candidates at once, if there are any."""
    config = outcome.config
    if config is None or config.caliper is None or config.kind != "propensity" or config.accessor is not None:
        return 0
    bad = config.attach(outcome.anchors).where("__bad").count()
    return bad if bad and not outcome.candidates.isEmpty() else 0


def exclusions(outcome: Outcome) -> DataFrame:
    """(category, reason, n, place) of the excluded pairs of the pool.

    Without a distance config the pool is the edges; if nothing but the window makes them, they too are counted
    without being built. With one it is every anchor with every candidate: pairs of
    unequal strata, and those beyond the caliper, are counted from the sizes of strata and the ranks of anchors
    and are never built. In transition runs what comes first is the risk set, which is any condition on both
    sides; there the pairs are tested one by one and only their counts leave the tasks.
    """
    spark = outcome.edges.sparkSession
    if outcome.invalid:
        counts = {(outcome.invalid.category, outcome.invalid.name): 1}
    elif outcome.config is None and "window" in outcome.notes:
        counts = _of_window(outcome, outcome.notes["window"])
    elif outcome.config is None:
        counts = _counted(classified(outcome, outcome.edges))
    elif outcome.transition:
        counts = _all_pairs(outcome)
    else:
        counts = _without_pairs(outcome)
    some = [(Reason(c, name or ""), n) for (c, name), n in counts.items() if n]
    some.sort(key=lambda x: x[0].order())
    rows = [(r.category, str(r), n, place) for place, (r, n) in enumerate(some)]
    return spark.createDataFrame(rows, "category string, reason string, n long, place long")


def _counted(rows: DataFrame) -> dict[tuple, int]:
    found = rows.where("category is not null").groupBy("category", "name").agg(F.count(F.lit(1)).alias("n")).collect()  # as many as there are reasons
    return {(r.category, r.name): r.n for r in found}


def _of_window(outcome: Outcome, width: int) -> dict[tuple, int]:
    """Counts of a run whose pool is the birth window alone: for every candidate that is used up, or whose unique
    value is, how many anchors of its stratum and window come after the one that has it."""
    criteria = outcome.criteria
    me = F.struct("__ord", "__id")
    anchors = outcome.anchors.where("__birth is not null").select("__grp", F.unix_date("__birth").alias("day"), F.col("__ord").alias("a_ord"), F.col("__id").alias("a_id"))
    pool = outcome.candidates.where("__birth is not null and __id is not null").select("__grp", F.unix_date("__birth").alias("day"), F.col("__id").alias("c_id"), F.col("__unique").alias("c_unique"))

    def held(rows: DataFrame, resource: Column, name: str) -> DataFrame:
        """rows with the earliest anchor that has the resource, (a_ord, a_id), or null."""
        return rows.join(_holders(outcome, resource).withColumnsRenamed({"__r": f"__r{name}", "__h": name}), F.col("c_id" if name == "used" else "__value") == F.col(f"__r{name}"), "left").drop(f"__r{name}")

    nobody = F.lit(None).cast(outcome.anchors.select(me.alias("h")).withColumn("h", F.struct(F.col("h.__ord").alias("a_ord"), F.col("h.__id").alias("a_id"))).schema["h"].dataType)
    pool = pool.withColumn("used", nobody) if criteria.allow_replacement else held(pool, F.col("c_id"), "used")
    if criteria.unique_by_key:
        pool = held(pool.withColumn("__value", F.concat(F.col("__grp"), F.lit(":"), F.col("c_unique"))), _scope(outcome), "reused")
    else:
        pool = pool.withColumn("reused", nobody)
    pool = written(pool.select("__grp", "day", "c_id", "used", "reused"), "held")
    asks = F.array(
        F.struct(F.lit(USED).alias("name"), F.lit(1).alias("sign"), F.col("used").alias("h")),
        F.struct(F.lit(UNIQUE).alias("name"), F.lit(1).alias("sign"), F.col("reused").alias("h")),
        F.struct(F.lit(UNIQUE).alias("name"), F.lit(-1).alias("sign"), F.when(F.col("reused").isNotNull(), F.col("used")).alias("h")),  # what is used is not counted again
    )
    asked = pool.select("__grp", "day", F.explode(asks).alias("q")).where("q.h is not null").select("__grp", "day", "q.name", "q.sign", F.col("q.h.a_ord").alias("h_ord"), F.col("q.h.a_id").alias("h_id"))
    found = anchors.groupBy("__grp").cogroup(asked.groupBy("__grp")).applyInArrow(lambda a, q: _later(a, q, width), "name string, n long")
    counts = {("constraint", r.name): r.n for r in found.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    selves = anchors.alias("x").join(pool.alias("y"), (F.col("x.a_id") == F.col("y.c_id")) & (F.col("x.__grp") == F.col("y.__grp")) & (F.abs(F.col("x.day") - F.col("y.day")) <= width))
    before = lambda name: F.coalesce(F.col(name) < F.struct("x.a_ord", "x.a_id"), F.lit(False))
    own = selves.agg(F.count_if(~before("used")).alias("n"), F.count_if(~before("used") & before("reused")).alias("both")).first()
    counts["constraint", SELF] = own.n
    counts["constraint", UNIQUE] = counts.get(("constraint", UNIQUE), 0) - own.both
    return counts


def _later(anchors: pa.Table, asked: pa.Table, width: int) -> pa.Table:
    """(name, n): anchors within the window of a question's day that come after its holder, summed by name."""
    anchors = anchors.take(pc.sort_indices(anchors, sort_keys=[("a_ord", "ascending"), ("a_id", "ascending")], null_placement="at_start"))
    turn = pc.fill_null(pc.index_in(asked.column("h_id"), anchors.column("a_id")).cast(pa.int64()), -1).to_numpy()
    day = anchors.column("day").to_numpy()
    order = np.argsort(day, kind="stable")
    days, at = day[order], asked.column("day").to_numpy()
    n = dominated(order, np.searchsorted(days, at - width, "left"), np.searchsorted(days, at + width, "right"), turn) * asked.column("sign").to_numpy()
    return pa.table({"name": asked.column("name"), "n": pa.array(n, pa.int64())}).group_by("name").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["name", "n"])


def _all_pairs(outcome: Outcome) -> dict[tuple, int]:
    config, a, c = outcome.config, side("a"), side("c")
    bad = _undefined_anchors(outcome)
    counts = {("distance_caliper", config.reason): bad * outcome.candidates.count()}
    left = config.attach(outcome.anchors)
    left = left.where("not __bad") if bad else left
    both = left.alias("a").join(config.attach(outcome.candidates).alias("c"), F.lit(True))
    distance = config.between(a("__x"), c("__x"))
    late = F.coalesce(F.when(~config.allows(distance), config.reason), first_blocking(outcome.notes["constraints"], a, c))
    pairs = both.select(
        a("__grp").alias("grp"), a("__id").alias("a_id"), a("__ord").alias("a_ord"), c("__id").alias("c_id"), c("__unique").alias("c_unique"),
        (~F.coalesce(outcome.risk(a, c), F.lit(False))).alias("filtered"), (a("__id") == c("__id")).alias("is_self"),
        (a("__grp") != c("__grp")).alias("other"), late.alias("reason"),
    )
    found = classified(outcome, pairs)
    # strata are compared after the record itself and before unique values
    early = F.col("category").eqNullSafe("additional_filter") | F.col("name").isin(USED, SELF)
    other = F.col("other") & ~F.coalesce(early, F.lit(False))
    counts |= _counted(found.withColumns({"name": F.when(other, STRATA).otherwise(F.col("name")), "category": F.when(other, "constraint").otherwise(F.col("category"))}))
    return counts


def _without_pairs(outcome: Outcome) -> dict[tuple, int]:
    config, criteria = outcome.config, outcome.criteria
    bad = _undefined_anchors(outcome)
    anchors = config.attach(outcome.anchors).where("not __bad") if bad else outcome.anchors
    anchors = anchors.select("__grp", F.struct("__ord", "__id").alias("me"), "__id")
    candidates = outcome.candidates.select("__grp", F.col("__id").alias("c_id"), "__unique")
    n = candidates.count()
    counts: dict[tuple, int] = {("distance_caliper", config.reason): bad * n}
    sizes = anchors.groupBy("__grp").agg(F.count(F.lit(1)).alias("n_a"))
    inside = sizes.join(candidates.groupBy("__grp").agg(F.count(F.lit(1)).alias("n_c")), "__grp").agg(F.sum(F.col("n_a") * F.col("n_c"))).first()[0] or 0
    selves = anchors.alias("x").join(candidates.alias("y"), F.col("x.__id") == F.col("y.c_id"))
    same = F.col("x.__grp") == F.col("y.__grp")
    own = selves.agg(F.count_if(~same).alias("out")).first()
    total = anchors.count() * n
    counts["constraint", STRATA] = total - inside - own.out

    # pairs of a stratum in which the candidate, or its unique value, went to an earlier anchor
    ranks = running_counts(anchors, ["__grp"], "me", {"n": F.lit(1)}).select(F.col("__grp").alias("g"), "me", "cum_n")
    after = F.col("n_a") - F.col("cum_n")

    def later(held: DataFrame) -> DataFrame:
        """held(g, h, ...) with how many anchors of the stratum come after h."""
        return held.join(ranks, (F.col("g") == held["g0"]) & (F.col("me") == F.col("h"))).join(sizes, F.col("g") == F.col("__grp")).withColumn("later", after)

    first = outcome.selected.groupBy(F.col("grp").alias("g0"), "c_id", "c_unique").agg(F.min(F.struct(F.col("a_ord").alias("__ord"), F.col("a_id").alias("__id"))).alias("h"))
    used = 0 if criteria.allow_replacement else later(first).agg(F.sum("later")).first()[0] or 0
    known = outcome.selected.select("c_id", F.struct(F.col("a_ord").alias("__ord"), F.col("a_id").alias("__id")).alias("h")).groupBy("c_id").agg(F.min("h").alias("h"))
    mine = selves.where(same).select(F.col("x.me").alias("me"), F.col("y.c_id").alias("c_id"), F.col("y.__unique").alias("c_unique"), F.col("x.__grp").alias("g1")).join(known, "c_id", "left")
    self_used = F.lit(False) if criteria.allow_replacement else F.coalesce(F.col("h") < F.col("me"), F.lit(False))
    free_selves = mine.where(~self_used)
    own_in = free_selves.count()
    unique = 0
    if criteria.unique_by_key:
        values = first.where("c_unique is not null").groupBy("g0", "c_unique").agg(F.min("h").alias("h"))
        having = candidates.where("__unique is not null").groupBy(F.col("__grp").alias("g0"), F.col("__unique").alias("c_unique")).agg(F.count(F.lit(1)).alias("k"))
        unique = later(values.join(having, ["g0", "c_unique"])).agg(F.sum(F.col("later") * F.col("k"))).first()[0] or 0
        if not criteria.allow_replacement:  # what is used is not counted again
            unique -= later(first.where("c_unique is not null")).agg(F.sum("later")).first()[0] or 0
        reused = free_selves.join(values.withColumnRenamed("h", "hv"), (F.col("g1") == F.col("g0")) & free_selves["c_unique"].eqNullSafe(values["c_unique"]))
        unique -= reused.where("hv < me").count()

    tested, built = _counted(classified(outcome, outcome.edges)), outcome.edges.count()
    for k, v in tested.items():
        counts[k] = counts.get(k, 0) + v
    beyond = {USED: used, SELF: own_in, UNIQUE: unique}
    for name, whole in beyond.items():
        counts["constraint", name] = whole
    left = sum(whole - tested.get(("constraint", name), 0) for name, whole in beyond.items())
    counts["constraint", SELF] += own.out
    if config.caliper is not None:
        counts["constraint", config.reason] = tested.get(("constraint", config.reason), 0) + inside - built - left
    return counts


def merged(*tables: DataFrame) -> DataFrame:
    """Exclusion counts of several runs, added by reason."""
    out = reduce(DataFrame.unionByName, tables).groupBy("category", "reason").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    return out.orderBy("place", "reason")
