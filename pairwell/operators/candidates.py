"""Candidate edges: pairs of an anchor and a candidate that may be matched, with what excludes the others."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions.distance import DistanceConfig
from pairwell.operators.constraints import Constraint, Side, exact_strata, first_blocking, no_self_match, side
from pairwell.plans.spec import MatchingCriteria

#: Bins are numbered within this; values beyond share the outermost ones, which the join condition then parts.
OUTERMOST = 2.0**62


def group_key(count: int) -> Column:
    """One string for the required strata, in which null is a value."""
    return F.to_json(F.array(*[F.col(f"__s{k}") for k in range(count)])) if count else F.lit("[]")


def dealt(anchors: DataFrame) -> DataFrame:
    """anchors dealt out evenly by anchor, so that neither a file that cannot be split nor a crowded bin is one task's.

    What is ranked by anchor behind a join that does not move the anchors then needs no shuffle of edges.
    """
    return anchors.repartition(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__grp", "__ord", "__id")


def band_join(anchors: DataFrame, candidates: DataFrame, keys: int, value: Callable[[Side], Column], width: float) -> DataFrame:
    """Pairs of equal strata (null equals null) whose values differ by at most width; aliases a and c.

    The candidate side is repeated into the three bins that its partners can be in, so that the bin is, with the
    strata, a key of an equi-join. Each pair meets in one bin. A task so tests some three pairs for each it gives,
    whatever the size of a stratum.
    """
    size = float(width) if width > 0 else 1.0
    size = size + 1 if size == int(size) else max(size * (1 + 1e-9), 1e-9)  # whole numbers part exactly; others get room for rounding

    def bin_of(x: Column) -> Column:
        x = x / F.lit(size)
        return F.floor(F.when(x > OUTERMOST, OUTERMOST).when(x < -OUTERMOST, -OUTERMOST).otherwise(x)).cast("long")

    left = dealt(anchors).alias("a").withColumn("__bin", bin_of(value(side("a")))).alias("a")
    spread = F.explode(F.array(*[bin_of(value(side("c"))) + k for k in (-1, 0, 1)]))
    right = candidates.alias("c").withColumn("__bin", spread).alias("c")
    a, c = side("a"), side("c")
    meet = (a("__bin") == c("__bin")) & exact_strata(keys).allows(a, c) & (F.abs(value(a) - value(c)) <= width)
    return left.join(right, meet)


def candidate_edges(
    anchors: DataFrame,
    candidates: DataFrame,
    criteria: MatchingCriteria,
    config: DistanceConfig | None = None,
    constraints: Sequence[Constraint] = (),
    risk: Callable[[Side, Side], Column] | None = None,
) -> DataFrame:
    """Edges of cohorts: (grp, a_day, a_id, a_ord, c_id, c_ord, c_unique, days, distance, filtered, is_self, reason).

    Without a config the birth window and the strata make the pool, silently. With one all candidates are the
    pool; pairs of unequal strata, and those beyond a caliper that can be a join condition, are left out here:
    pairwell.operators.diagnostics counts them without building them. Without a caliper every pair of a stratum
    is eligible by definition.

    filtered: what is excluded before all else (risk set, support). is_self: both sides are one record. reason:
    the first of the caliper and the further constraints that fails, or null.
    """
    keys = len(criteria.required_strata)
    channel = config or DistanceConfig.date()
    a, c = side("a"), side("c")
    left, right = channel.attach(anchors), channel.attach(candidates)
    if config is None:
        pairs = band_join(left, right, keys, lambda s: F.unix_date(s("__birth")), criteria.birth_window_days)
    elif channel.band(a) is not None:
        room = 1 + 1e-9 if config.kind == "mahalanobis" else 1  # a coordinate is computed apart from the distance
        pairs = band_join(left, right, keys, channel.band, float(config.caliper.value) * room)
    else:
        pairs = dealt(left).alias("a").join(right.alias("c"), exact_strata(keys).allows(a, c))
    distance = channel.between(a("__x"), c("__x"))
    within = Constraint(channel.reason, lambda _a, _c: channel.allows(distance))
    keep = risk(a, c) if risk else F.lit(True)
    return pairs.select(
        a("__grp").alias("grp"),
        F.unix_date(a("__birth")).alias("a_day"),
        a("__id").alias("a_id"),
        a("__ord").alias("a_ord"),
        c("__id").alias("c_id"),
        c("__ord").alias("c_ord"),
        c("__unique").alias("c_unique"),
        F.abs(F.datediff(c("__birth"), a("__birth"))).alias("days"),
        distance.alias("distance"),
        (~F.coalesce(keep, F.lit(False))).alias("filtered"),
        (~no_self_match().allows(a, c)).alias("is_self"),
        first_blocking([within, *constraints], a, c).alias("reason"),
    )


def eligible(edges: DataFrame) -> DataFrame:
    """Edges that nothing static excludes."""
    return edges.where(~F.col("filtered") & ~F.col("is_self") & F.col("reason").isNull())
