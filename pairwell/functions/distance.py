"""Distance channels: what gates pairs, as column expressions over the two sides of an edge."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.plans.spec import DistanceCaliper, SpecError
from pairwell.sources.cohort import finite


#: From a column's name to that column of a record.
Side = Callable[[str], Column]


class MahalanobisError(SpecError):
    """The dimension is zero, or the matrix does not have dimension squared entries."""


def date_distance(a: Column, c: Column) -> Column:
    """Days between two dates."""
    return F.abs(F.datediff(c, a)).cast("double")


def score_distance(a: Column, c: Column) -> Column:
    """Difference of two scores; null if either is missing or not finite."""
    return F.abs(finite(a) - finite(c))


def quadratic_form(a: Column, c: Column, inverse_covariance: Sequence[float], dimension: int) -> Column:
    """Mahalanobis distance of two array columns; null if undefined."""
    check_matrix(inverse_covariance, dimension)
    if not all(math.isfinite(x) for x in inverse_covariance):
        return F.lit(None).cast("double")
    delta = [F.get(a, F.lit(i)) - F.get(c, F.lit(i)) for i in range(dimension)]
    total = F.lit(0.0)
    for i in range(dimension):
        for j in range(dimension):
            w = float(inverse_covariance[i * dimension + j])
            if w:
                total = total + F.lit(w) * delta[i] * delta[j]
    fits = (F.size(a) == dimension) & (F.size(c) == dimension)
    total = finite(F.when(fits, total))
    return F.when(total >= -1e-12, F.sqrt(F.greatest(total, F.lit(0.0))))


def check_matrix(inverse_covariance: Sequence[float], dimension: int) -> None:
    if dimension < 1:
        raise MahalanobisError("dimension must be at least 1")
    if len(inverse_covariance) != dimension * dimension:
        raise MahalanobisError(f"{len(inverse_covariance)} entries for dimension {dimension}")


def whitening(inverse_covariance: Sequence[float], dimension: int) -> np.ndarray | None:
    """U with U'U equal to the (symmetric part of the) matrix, or None if it is not positive definite."""
    m = np.asarray(inverse_covariance, float).reshape(dimension, dimension)
    try:
        return np.linalg.cholesky((m + m.T) / 2).T
    except np.linalg.LinAlgError:
        return None


def whiten(x: Column, u: np.ndarray) -> Column:
    """u times an array column, so that distances become Euclidean; null if undefined."""
    rows = []
    for row in u:
        total = F.lit(0.0)
        for j, w in enumerate(row.tolist()):
            if w:
                total = total + F.lit(w) * F.get(x, F.lit(j))
        rows.append(finite(total))
    out = F.array(*rows)
    return F.when((F.size(x) == u.shape[1]) & ~F.exists(out, lambda v: v.isNull()), out)


def euclidean(a: Column, c: Column, dimension: int) -> Column:
    total = F.lit(0.0)
    for i in range(dimension):
        d = F.get(a, F.lit(i)) - F.get(c, F.lit(i))
        total = total + d * d
    return F.sqrt(total)


@dataclass(frozen=True)
class DistanceConfig:
    """A distance with an optional caliper and the reason it gives; an explicit one switches the birth window off.

    values is a table with the value of each id: (id, score) or (id, vector). If an id occurs twice, its
    greatest value counts. accessor gives the value as a column of the record's own instead.
    """

    kind: str
    caliper: DistanceCaliper | None = None
    reason: str = "distance_caliper"
    values: DataFrame | None = None
    inverse_covariance: tuple[float, ...] = ()
    dimension: int = 0
    accessor: Callable[[Side], Column] | None = None

    @classmethod
    def date(cls, caliper: DistanceCaliper | None = None) -> DistanceConfig:
        return cls("date", caliper, "date_caliper")

    @classmethod
    def propensity(cls, scores: DataFrame, caliper: DistanceCaliper | None = None) -> DistanceConfig:
        return cls("propensity", caliper, "propensity_score_caliper", scores.toDF("id", "score"))

    @classmethod
    def propensity_of(cls, accessor: Callable[[Side], Column], caliper: DistanceCaliper | None = None) -> DistanceConfig:
        return cls("propensity", caliper, "propensity_score_caliper", accessor=accessor)

    @classmethod
    def mahalanobis_of(cls, accessor: Callable[[Side], Column], inverse_covariance: Sequence[float], dimension: int, caliper: DistanceCaliper | None = None) -> DistanceConfig:
        check_matrix(inverse_covariance, dimension)
        return cls("mahalanobis", caliper, "mahalanobis_caliper", None, tuple(map(float, inverse_covariance)), dimension, accessor)

    @classmethod
    def mahalanobis(cls, vectors: DataFrame, inverse_covariance: Sequence[float], dimension: int, caliper: DistanceCaliper | None = None) -> DistanceConfig:
        check_matrix(inverse_covariance, dimension)
        return cls("mahalanobis", caliper, "mahalanobis_caliper", vectors.toDF("id", "vector"), tuple(map(float, inverse_covariance)), dimension)

    def with_reason(self, reason: str) -> DistanceConfig:
        return replace(self, reason=reason)

    def attach(self, rows: DataFrame) -> DataFrame:
        """rows(__id) with __x, what the distance is taken of, and __bad: a score is there but not finite."""
        if self.kind == "date":
            return rows.withColumns({"__x": F.col("__birth"), "__bad": F.lit(False)})
        value = F.col("__value")
        if self.kind == "mahalanobis":
            u = self.root()
            value = whiten(value, u) if u is not None else value
        if self.accessor is not None:
            joined = rows.withColumn("__value", self.accessor(F.col))
        else:
            name = "score" if self.kind == "propensity" else "vector"
            values = self.values.groupBy(F.col("id").cast("string").alias("__key")).agg(F.max(name).alias("__value"))
            joined = rows.join(values, F.col("__id") == F.col("__key"), "left").drop("__key")
        if self.kind == "propensity":
            bad = F.col("__value").isNotNull() & finite(F.col("__value")).isNull() & F.lit(self.accessor is None)
            return joined.withColumn("__bad", bad).withColumn("__x", finite(value)).drop("__value")
        return joined.withColumns({"__x": value, "__bad": F.lit(False)}).drop("__value")

    def band(self, row: Side) -> Column | None:
        """A number by which any two records within the caliper differ by at most the caliper; None if there is none."""
        if self.caliper is None:
            return None
        if self.kind == "date":
            return F.unix_date(row("__x"))
        if self.kind == "propensity":
            return row("__x")
        return F.get(row("__x"), F.lit(0)) if self.root() is not None else None

    def root(self) -> np.ndarray | None:
        if not np.isfinite(self.inverse_covariance).all():
            return None
        return whitening(self.inverse_covariance, self.dimension)

    def between(self, a: Column, c: Column) -> Column:
        """The distance of the __x of two sides; null if undefined."""
        if self.kind == "date":
            return date_distance(a, c)
        if self.kind == "propensity":
            return score_distance(a, c)
        if self.root() is not None:
            return euclidean(a, c, self.dimension)
        return quadratic_form(a, c, self.inverse_covariance, self.dimension)

    def allows(self, distance: Column) -> Column:
        """Whether a distance is within the caliper; undefined distances are not. Without a caliper all are."""
        if self.caliper is None:
            return F.lit(True)
        return F.coalesce(finite(distance) <= float(self.caliper.value), F.lit(False))
