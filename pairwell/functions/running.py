"""Running totals over a sorted table, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.sources.staging import written


def running_counts(rows: DataFrame, keys: Sequence[str], by: str, sums: Mapping[str, Column]) -> DataFrame:
    """(keys, by, <name>, cum_<name>): per key and distinct value, its own sums and those of all rows up to it.

    Distinct values are range-partitioned and summed within each partition; the totals of earlier partitions, a
    table of partitions times keys, are added.
    """
    name = list(sums)
    counted = rows.groupBy(*keys, by).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    parts = written(counted.repartitionByRange(*keys, by).withColumn("__part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "__part").orderBy(by)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "__part").agg(*[F.sum(k).alias(k) for k in name])
    offsets = totals.select(*keys, "__part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__off_{k}") for k in name])
    out = parts.select(*keys, by, "__part", *name, *[F.sum(k).over(within).alias(f"__in_{k}") for k in name])
    out = out.join(F.broadcast(offsets), [*keys, "__part"])
    return out.select(*keys, by, *name, *[(F.col(f"__in_{k}") + F.col(f"__off_{k}")).alias(f"cum_{k}") for k in name])
