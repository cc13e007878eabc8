"""Covariates of records: one map column from key to (kind, num, cat), as in a tagged union.

A key that is absent differs from one whose value is explicitly missing: the first lets a supplemental table
speak, the second does not and is a level of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.sources.cohort import finite

TYPE = "map<string,struct<kind:string,num:double,cat:string>>"
NUMERIC, CATEGORICAL, MISSING = "numeric", "categorical", "missing"


def entry(key: str, kind: str, value: Column) -> Column:
    """One entry; a null value, or a number that is not finite, is missing."""
    num = finite(value.cast("double")) if kind == NUMERIC else F.lit(None).cast("double")
    cat = value.cast("string") if kind == CATEGORICAL else F.lit(None).cast("string")
    known = num if kind == NUMERIC else cat
    return F.struct(F.lit(key).alias("key"), F.struct(F.when(known.isNotNull(), F.lit(kind)).otherwise(F.lit(MISSING)).alias("kind"), num.alias("num"), cat.alias("cat")).alias("value"))


def covariates(numeric: Sequence[str] = (), categorical: Sequence[str] = (), absent: bool = False) -> Column:
    """The map of typed columns. Nulls are missing values, or with absent, keys that are not there."""
    cells = [entry(c, NUMERIC, F.col(c)) for c in numeric] + [entry(c, CATEGORICAL, F.col(c)) for c in categorical]
    if not cells:
        return F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<kind:string,num:double,cat:string>>>"))
    cells = F.array(*cells)
    if absent:
        cells = F.filter(cells, lambda x: x["value"]["kind"] != MISSING)
    return F.map_from_entries(cells)


def with_supplemental(rows: DataFrame, id_col: str, column: str, extra: DataFrame | None) -> DataFrame:
    """rows whose map has the entries of extra(id, covariates) for the keys that it lacks."""
    if extra is None:
        return rows
    more = extra.toDF("__unit", "__more")
    own = F.col(column)
    added = F.map_concat(F.map_filter("__more", lambda k, _: ~F.map_contains_key(own, k)), own)
    out = rows.join(more, F.col(id_col).cast("string") == F.col("__unit").cast("string"), "left")
    return out.withColumn(column, F.when(F.col("__more").isNull(), own).otherwise(added)).drop("__unit", "__more")


def keys_by_kind(rows: DataFrame, column: str, first: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric keys, other keys), sorted. A key is of the kind that the first record which has it has, in the order of first."""
    cells = rows.select(F.struct(*first).alias("place"), F.explode(column).alias("key", "value"))
    kinds = cells.groupBy("key").agg(F.min_by("value.kind", "place").alias("kind")).collect()  # one row a covariate
    numeric = sorted(r.key for r in kinds if r.kind == NUMERIC)
    return numeric, sorted(r.key for r in kinds if r.kind != NUMERIC)


def number(column: str, key: str) -> Column:
    """The finite number under a key, or null."""
    cell = F.try_element_at(F.col(column), F.lit(key))
    return F.when(cell["kind"] == NUMERIC, finite(cell["num"]))


def level(column: str, key: str) -> Column:
    """The level under a key: numbers are one level, and so are missing and absent values."""
    cell = F.try_element_at(F.col(column), F.lit(key))
    return F.when(cell.isNull() | (cell["kind"] == MISSING), MISSING).when(cell["kind"] == NUMERIC, NUMERIC).otherwise(cell["cat"])


def present(column: str, key: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col(column), key), F.lit(False))
