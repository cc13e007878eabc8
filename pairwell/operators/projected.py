"""Balance of covariates projected from a population: cases against the rest, and matched against matched."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smd_of_values(n1: Column, n0: Column, m1: Column, m0: Column, v1: Column, v0: Column) -> Column:
    """SMD with sample variances (of fewer than two values: zero); zero if a side is empty or nothing finite comes out."""
    sd = F.sqrt((F.coalesce(v1, F.lit(0.0)) + F.coalesce(v0, F.lit(0.0))) / 2)
    ok = (n1 > 0) & (n0 > 0) & (sd > 0) & (sd < float("inf"))
    return F.coalesce(F.when(ok, (m1 - m0) / sd), F.lit(0.0))


def projected_balance(population: DataFrame, cases: DataFrame, matched_cases: DataFrame, matched_controls: DataFrame, id_col: str, numeric: Mapping[str, Column], categorical: Mapping[str, Column]) -> DataFrame:
    """(place, covariate, metric_type, smd_before, smd_after), numeric covariates first.

    Before: cases against the population without them. After: the members of the population whose ids are in
    matched_cases(id) and matched_controls(id), each once however often it was matched. Numbers are compared by
    SMD, levels by the greatest difference of a proportion.
    """

    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(df.columns[0] if name != "__c" else id_col).cast("string").alias("__unit"), F.lit(True).alias(name)).distinct()

    own = F.col(id_col).cast("string")
    rows = population.withColumn("__unit", own)
    for df, name in ((cases, "__c"), (matched_cases, "__mc"), (matched_controls, "__mk")):
        rows = rows.join(ids(df, name), "__unit", "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    groups = F.filter(F.array(F.when(~flag("__c"), "control_before"), F.when(flag("__mc"), "case_after"), F.when(flag("__mk"), "control_after")), lambda x: x.isNotNull())
    place = {k: i for i, k in enumerate([*numeric, *categorical])}
    cells = [F.struct(F.lit(place[k]).alias("place"), F.lit(k).alias("covariate"), x.cast("double").alias("x"), F.lit(None).cast("string").alias("level")) for k, x in numeric.items()]
    cells += [F.struct(F.lit(place[k]).alias("place"), F.lit(k).alias("covariate"), F.lit(None).cast("double").alias("x"), x.cast("string").alias("level")) for k, x in categorical.items()]
    cells = F.array(*cells)
    long = rows.select(groups.alias("g"), cells.alias("cells")).unionByName(cases.select(F.array(F.lit("case_before")).alias("g"), cells.alias("cells")))
    long = long.select(F.explode("g").alias("grp"), "cells").select("grp", F.explode("cells").alias("c")).select(F.split_part("grp", F.lit("_"), F.lit(1)).alias("role"), F.split_part("grp", F.lit("_"), F.lit(2)).alias("phase"), "c.*")
    is_number = F.col("covariate").isin(*numeric) if numeric else F.lit(False)

    of = lambda role: F.when(F.col("role") == role, F.col("x"))
    stats = [f(of(r)) for f in (F.count, F.avg, F.var_samp) for r in ("case", "control")]
    numbers = long.where(is_number).groupBy("place", "covariate", "phase").agg(smd_of_values(*stats).alias("smd"), F.lit("numeric").alias("metric_type"))
    counted = long.where(~is_number).groupBy("place", "covariate", "phase", "level").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("case", "control")])
    total = counted.groupBy("place", "covariate", "phase").agg(*[F.greatest(F.sum(r), F.lit(1)).alias(f"n_{r}") for r in ("case", "control")])
    gap = F.abs(F.col("case") / F.col("n_case") - F.col("control") / F.col("n_control"))
    levels = counted.join(F.broadcast(total), ["place", "covariate", "phase"]).groupBy("place", "covariate", "phase").agg(F.max(gap).alias("smd"), F.lit("categorical_max_abs_diff").alias("metric_type"))  # total: two rows per covariate
    both = numbers.unionByName(levels)
    at = lambda p: F.coalesce(F.max(F.when(F.col("phase") == p, F.col("smd"))), F.lit(0.0))
    found = both.groupBy("place").agg(at("before").alias("smd_before"), at("after").alias("smd_after"))
    spine = population.sparkSession.createDataFrame([(i, k, "numeric" if k in numeric else "categorical_max_abs_diff") for k, i in place.items()], "place int, covariate string, metric_type string")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return spine.join(F.broadcast(found), "place", "left").select("place", "covariate", "metric_type", zero("smd_before"), zero("smd_after")).orderBy("place")  # a row per covariate
