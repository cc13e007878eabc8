"""Design matrices: covariates encoded as one array column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions.covariates import CATEGORICAL, MISSING, NUMERIC
from pairwell.functions.running import running_counts
from pairwell.plans.estimation import EMPTY_INPUT, MISSING_VALUES, MIXED_TYPE, NO_COVARIATES, NO_VALUES, NON_FINITE, Encoding, EstimationError, MissingPolicy
from pairwell.sources.staging import written

#: The name of the constant column, the level of missing categories, and what counts as constant.
INTERCEPT = "intercept"
MISSING_LEVEL = "__missing__"
CONSTANT = 1e-12


@dataclass(frozen=True)
class Design:
    """rows(id, label, x): label 1 for anchors, 0 for candidates; x the values of columns."""

    rows: DataFrame
    columns: tuple[str, ...]


def pooled(anchors: DataFrame, candidates: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, label, covariates) of both sides."""
    side = lambda df, y: df.select(F.col(id_col).cast("string").alias("id"), F.lit(y).alias("label"), F.col(column).alias("covariates"))
    return side(anchors, 1.0).unionByName(side(candidates, 0.0))


def _schema(rows: DataFrame, encoding: Encoding) -> tuple[list[tuple[str, str, object]], int]:
    """(key, kind, mean or levels) of the keys that are encoded, and the number of rows.

    One pass counts kinds and sums numbers by key; another lists the levels of categorical keys, of which the
    design has a column each.
    """
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1.0) or not sizes.get(0.0):
        raise EstimationError(EMPTY_INPUT)
    n = sum(sizes.values())
    cells = rows.select("id", F.explode("covariates").alias("key", "value"))
    num, kind = F.col("value.num"), F.col("value.kind")
    bad = (kind == NUMERIC) & (num.isNull() | ~(F.abs(num) < float("inf")))
    stats = cells.groupBy("key").agg(
        F.count_if(kind == NUMERIC).alias("numbers"), F.count_if(kind == CATEGORICAL).alias("levels"), F.avg(F.when(kind == NUMERIC, num)).alias("mean"), F.min(F.when(bad, F.col("id"))).alias("bad"))
    stats = {r.key: r for r in stats.collect()}  # a row per covariate
    out: list[tuple[str, str, object]] = []
    for key in encoding.keys or sorted(stats):
        s = stats.get(key)
        if s is not None and s.bad is not None:
            raise EstimationError(NON_FINITE, key, s.bad)
        numbers, levels = (s.numbers, s.levels) if s is not None else (0, 0)
        if numbers and levels:
            raise EstimationError(MIXED_TYPE, key)
        if not numbers and not levels:
            if encoding.keys:
                raise EstimationError(NO_VALUES, key)
            continue
        missing = numbers + levels < n
        if missing and encoding.missing is MissingPolicy.ERROR:
            raise EstimationError(MISSING_VALUES, key)
        out.append((key, NUMERIC if numbers else CATEGORICAL, s.mean if numbers else missing))
    categorical = [k for k, kind, _ in out if kind == CATEGORICAL]
    found: dict[str, list[str]] = {k: [] for k in categorical}
    if categorical:
        pairs = cells.where((F.col("value.kind") == CATEGORICAL) & F.col("key").isin(categorical)).select("key", "value.cat").distinct()
        for r in pairs.collect():  # a column of the design each
            found[r.key].append(r.cat)
    done: list[tuple[str, str, object]] = []
    for key, kind, extra in out:
        if kind == CATEGORICAL:
            levels = sorted({*found[key], *([MISSING_LEVEL] if extra else [])})
            extra = levels[1:] if encoding.drop_first_level and len(levels) > 1 else levels
        done.append((key, kind, extra))
    return done, n


def design_matrix(anchors: DataFrame, candidates: DataFrame, encoding: Encoding, id_col: str = "id", column: str = "covariates") -> Design:
    """Numbers as they are (missing ones as the mean), a 0/1 column per level; columns that do not vary are dropped."""
    rows = pooled(anchors, candidates, id_col, column)
    schema, _ = _schema(rows, encoding)
    if not schema and not encoding.intercept:
        raise EstimationError(NO_COVARIATES)
    names: list[str] = [INTERCEPT] if encoding.intercept else []
    values: list[Column] = [F.lit(1.0)] if encoding.intercept else []
    for key, kind, extra in schema:
        cell = F.try_element_at(F.col("covariates"), F.lit(key))
        if kind == NUMERIC:
            names.append(key)
            values.append(F.coalesce(cell["num"], F.lit(extra)))
            continue
        level = F.when(cell.isNull() | (cell["kind"] == MISSING), MISSING_LEVEL).otherwise(cell["cat"])
        names += [f"{key}={x}" for x in extra]
        values += [F.when(level == x, 1.0).otherwise(0.0) for x in extra]
    full = written(rows.select("id", "label", F.array(*values).alias("x")), "design")
    width = len(names)

    def extremes(batches):
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for b in batches:
            x = _matrix(b, width)
            if len(x):
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["k", "low", "high"])

    ranges = full.select("x").mapInArrow(extremes, "k long, low double, high double").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spread = {r.k: r.high - r.low for r in ranges.collect()}  # a row per column
    keep = [k for k in range(width) if names[k] == INTERCEPT or abs(spread[k]) > CONSTANT]
    if not keep:
        raise EstimationError(NO_COVARIATES)
    if len(keep) < width:
        full = full.withColumn("x", F.array(*[F.get("x", F.lit(k)) for k in keep]))
    return Design(full, tuple(names[k] for k in keep))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def ranked(design: Design) -> Design:
    """Each column as its average rank among all rows. Columns are ranked one after the other, without gathering any."""
    rows = design.rows.withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows, "rows")
    cells = rows.select("__row", F.posexplode("x").alias("k", "v"))
    counted = running_counts(cells, ["k"], "v", {"n": F.lit(1)})
    own = cells.groupBy("k", "v").agg(F.count(F.lit(1)).alias("m"))
    rank = counted.join(own, ["k", "v"]).select("k", "v", (F.col("cum_n") - (F.col("m") - 1) / 2).alias("r"))
    back = cells.join(rank, ["k", "v"]).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("c"))
    out = rows.drop("x").join(back, "__row").select("id", "label", F.transform("c", lambda s: s["r"]).alias("x"))
    return Design(written(out, "ranks"), design.columns)


