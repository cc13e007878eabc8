"""Weights of matched units and of subclasses, and effective sample sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions.running import running_counts
from pairwell.plans.spec import Estimand


def pair_weights(pairs: DataFrame, estimand: Estimand = Estimand.ATT) -> DataFrame:
    """pairs plus weight: each anchor (ATT) or each candidate (ATC) shares one among its pairs; else each pair has one."""
    unit = {Estimand.ATT: "anchor_id", Estimand.ATC: "candidate_id"}.get(estimand)
    n = F.count(F.lit(1)).over(Window.partitionBy(unit)) if unit else F.lit(1)
    return pairs.withColumn("weight", F.lit(1.0) / n)


def match_weights(pairs: DataFrame, estimand: Estimand = Estimand.ATT) -> DataFrame:
    """(unit_id, role, match_weight): the sum of a unit's pair weights."""
    both = pair_weights(pairs, estimand).select(F.explode(F.array(*[F.struct(F.col(f"{r}_id").alias("unit_id"), F.lit(r).alias("role"), "weight") for r in ("anchor", "candidate")])).alias("u"))
    return both.groupBy("u.unit_id", "u.role").agg(F.sum("u.weight").alias("match_weight"))


def unit_table(weights: DataFrame, sampling: DataFrame | None = None) -> DataFrame:
    """weights plus sampling_weight (null if not given) and analysis_weight, their product."""
    if sampling is None:
        out = weights.withColumn("sampling_weight", F.lit(None).cast("double"))
    else:
        given = sampling.toDF("__unit", "sampling_weight")
        out = weights.join(given, F.col("unit_id") == F.col("__unit"), "left").drop("__unit").withColumn("sampling_weight", F.coalesce("sampling_weight", F.lit(1.0)))
    return out.withColumn("analysis_weight", F.col("match_weight") * F.coalesce("sampling_weight", F.lit(1.0)))


def effective_sample_size(weight: Column) -> Column:
    """(sum w)^2 / sum w^2 over finite positive weights; zero if there are none."""
    w = F.when((weight > 0) & (weight < float("inf")), weight)
    squares = F.sum(w * w)
    return F.when(squares > 2.220446049250313e-16, F.pow(F.sum(w), F.lit(2.0)) / squares).otherwise(0.0)


def weight_totals(table: DataFrame) -> DataFrame:
    """(role, total, ess) of the analysis weights of a unit table; total_weight is their sum over both roles."""
    return table.groupBy("role").agg(F.sum("analysis_weight").alias("total"), effective_sample_size(F.col("analysis_weight")).alias("ess"))


def cutpoints(scores: DataFrame, subclasses: int) -> list[float] | None:
    """The scores at the positions b (n - 1) div k of the sorted table, b from 1 to k - 1; None without scores."""
    total = scores.count()
    if not total:
        return None
    at = [b * (total - 1) // subclasses for b in range(1, subclasses)] if total > 1 else []
    if not at:
        return []
    counted = running_counts(scores.select("score"), [], "score", {"n": F.lit(1)})
    return list(counted.agg(*[F.min(F.when(F.col("cum_n") > p, F.col("score"))) for p in at]).first())


@dataclass(frozen=True)
class Subclasses:
    """units(unit_id, role, score, subclass, weight, ...) that are kept, what is dropped, and the subclasses.

    dropped(unit_id, role, why, place): units without a finite score first, anchors before candidates, then those
    of subclasses that lack a role. table(subclass, anchor_count, candidate_count, propensity): all subclasses,
    empty ones too.
    """

    units: DataFrame
    dropped: DataFrame
    table: DataFrame
    requested: int

    def realized(self) -> int:
        return self.table.where("anchor_count > 0 and candidate_count > 0").count()


def subclassify(units: DataFrame, estimand: Estimand = Estimand.ATT, subclasses: int = 6, reference: str | None = None) -> Subclasses:
    """Cut units(unit_id, role, score) into subclasses by quantiles of the reference group's scores.

    role is anchor or candidate. reference: anchor, candidate or pooled; by default the estimand's. Without any
    finite score in the reference group all units are dropped. Ids are unique over both roles.
    """
    spark, wanted = units.sparkSession, max(subclasses, 1)
    reference = reference or {Estimand.ATT: "anchor", Estimand.ATC: "candidate"}.get(estimand, "pooled")
    fine = F.coalesce(F.abs("score") < float("inf"), F.lit(False))
    ok = units.where(fine)
    cuts = cutpoints(ok if reference == "pooled" else ok.where(F.col("role") == reference), wanted)
    order = {(w, r): i for i, (w, r) in enumerate((w, r) for w in ("no_score", "no_overlap") for r in ("anchor", "candidate"))}

    def gone(rows: DataFrame, why: str) -> DataFrame:
        place = F.when(F.col("role") == "anchor", order[why, "anchor"]).otherwise(order[why, "candidate"])
        return rows.select("unit_id", "role", F.lit(why).alias("why"), place.alias("place"))

    summary = "subclass long, anchor_count long, candidate_count long, propensity double"
    if cuts is None:
        kept = ok.where("false").withColumns({"subclass": F.lit(0), "weight": F.lit(1.0)})
        return Subclasses(kept, gone(units, "no_score"), spark.createDataFrame([], summary), wanted)
    below = sum((F.when(F.col("score") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = ok.withColumn("subclass", below)
    counts = placed.groupBy(F.col("subclass").alias("__s")).agg(F.count_if(F.col("role") == "anchor").alias("__a"), F.count_if(F.col("role") == "candidate").alias("__c"))
    out = placed.join(F.broadcast(counts), F.col("subclass") == F.col("__s"))  # at most `subclasses` rows
    a, c = F.col("__a").cast("double"), F.col("__c").cast("double")
    of_anchor = {Estimand.ATT: F.lit(1.0), Estimand.ATC: F.try_divide(c, a)}.get(estimand, F.try_divide(a + c, a))
    of_candidate = {Estimand.ATT: F.try_divide(a, c), Estimand.ATC: F.lit(1.0)}.get(estimand, F.try_divide(a + c, c))
    out = out.withColumn("weight", F.when(F.col("role") == "anchor", of_anchor).otherwise(of_candidate))
    both = (F.col("__a") > 0) & (F.col("__c") > 0)
    dropped = gone(units.where(~fine), "no_score").unionByName(gone(out.where(~both), "no_overlap"))
    all_ = spark.range(len(cuts) + 1).withColumnRenamed("id", "subclass").join(F.broadcast(counts), F.col("subclass") == F.col("__s"), "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0).cast("long"))
    table = all_.select("subclass", n("__a").alias("anchor_count"), n("__c").alias("candidate_count"), F.try_divide(n("__a"), n("__a") + n("__c")).alias("propensity"))
    return Subclasses(out.where(both).drop("__s", "__a", "__c"), dropped, table, wanted)
