"""Propensity scores and Mahalanobis distances, estimated from covariates.

Each iteration is one pass over the design: a task sums its rows' share of the normal equations, or of the
gradient, as one small matrix product, and only sums of the size of the model come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions.distance import DistanceConfig, MahalanobisError
from pairwell.operators.constraints import Constraint
from pairwell.operators.design import INTERCEPT, Design, design_matrix, ranked
from pairwell.operators.matching import Outcome, Strategy, match_standard, nearest_birth_date
from pairwell.plans.estimation import (
    BAD_COVARIANCE, BAD_DISTANCE, SOLVE_FAILED, CovarianceOf, ElasticNet, EstimationError, Logit, MahalanobisConfig, PropensityConfig, Scale, Transformed,
)
from pairwell.plans.spec import DistanceCaliper, MatchingCriteria, MatchRatio
from pairwell.sources.cohort import CohortSchema
from pairwell.sources.staging import written

#: Pivots and ridges of the solvers.
PIVOT = 1e-14
FIRST_RIDGE = 1e-8
SOLVE_ATTEMPTS = 8


@dataclass(frozen=True)
class Fit:
    coefficients: tuple[float, ...]
    converged: bool
    iterations: int


@dataclass(frozen=True)
class Propensity:
    """scores(id, label, probability, linear_predictor, distance_score), and how they came about."""

    scores: DataFrame
    columns: tuple[str, ...]
    fit: Fit
    estimator: str
    config: DistanceConfig


@dataclass(frozen=True)
class Mahalanobis:
    """vectors(id, vector), the inverse covariance row by row, and the distance config made of them."""

    vectors: DataFrame
    inverse_covariance: tuple[float, ...]
    covariance: tuple[float, ...]
    columns: tuple[str, ...]
    config: DistanceConfig

    @property
    def dimension(self) -> int:
        return len(self.columns)


def solve(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan with partial pivoting; None where a pivot vanishes."""
    work = np.column_stack([matrix, rhs]).astype(np.float64)
    size = len(matrix)
    for p in range(size):
        row = p + int(np.argmax(np.abs(work[p:, p])))
        if not abs(work[row, p]) > PIVOT:
            return None
        work[[p, row]] = work[[row, p]]
        work[p] /= work[p, p]
        others = np.arange(size) != p
        work[others] -= np.outer(work[others, p], work[p])
    return work[:, size:]


def solve_with_ridge(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution, with a ridge that grows tenfold from 1e-8 where there is none without."""
    ridges = [0.0, *[FIRST_RIDGE * 10.0**k for k in range(SOLVE_ATTEMPTS - 1)]]
    for ridge in ridges:
        found = solve(matrix + ridge * np.eye(len(matrix)), rhs)
        if found is not None:
            return found[:, 0]
    raise EstimationError(SOLVE_FAILED)


def inverse_with_ridge(matrix: np.ndarray, ridge: float, attempts: int) -> np.ndarray:
    """The inverse of matrix plus ridge, which grows tenfold while there is none."""
    now = max(ridge, 0.0)
    for attempt in range(max(attempts, 1)):
        found = solve(matrix + now * np.eye(len(matrix)), np.eye(len(matrix)))
        if found is not None:
            return found
        now = FIRST_RIDGE if attempt == 0 and now == 0.0 else now * 10.0
    raise EstimationError(BAD_COVARIANCE)


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, width)
    return batch.column(0).to_numpy(zero_copy_only=False), x


def sums(design: Design, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """of(labels, rows) summed over all batches: a fixed number of values from each task."""
    width = len(design.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of(*_rows(b, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    found = design.rows.select("label", "x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("k").to_numpy()] = found.column("v").to_numpy()
    return out


def clipped_sigmoid(linear: np.ndarray, clip: float) -> np.ndarray:
    e = np.exp(-np.abs(linear))
    return np.clip(np.where(linear >= 0, 1 / (1 + e), e / (1 + e)), clip, 1 - clip)


def fit_logit(design: Design, config: Logit) -> Fit:
    """Iteratively reweighted least squares from zero, with a small penalty off the intercept."""
    width = len(design.columns)
    free = np.array([c == INTERCEPT for c in design.columns])
    beta, converged, rounds = np.zeros(width), False, 0
    while rounds < config.max_iter and not converged:
        rounds += 1

        def normal(y: np.ndarray, x: np.ndarray, beta: np.ndarray = beta) -> np.ndarray:
            linear = x @ beta
            p = clipped_sigmoid(linear, config.clip)
            w = np.maximum(p * (1 - p), config.clip)
            return np.r_[(x.T @ (x * w[:, None])).ravel(), x.T @ (w * linear + (y - p))]

        found = sums(design, normal)
        matrix, target = found[: width * width].reshape(width, width), found[width * width :]
        after = solve_with_ridge(matrix + np.diag(np.where(free, 0.0, max(config.l2, 0.0))), target)
        converged = bool(np.max(np.abs(after - beta)) <= config.tolerance)
        beta = after
    return Fit(tuple(beta.tolist()), converged, rounds)


def fit_elastic_net(design: Design, config: ElasticNet) -> Fit:
    """Proximal gradient steps on the mean loss; the intercept is not penalized.

    Rows that are equal are one weighted row, so that few distinct rows make short passes.
    """
    config.check()
    width = len(design.columns)
    free = np.array([c == INTERCEPT for c in design.columns])
    l1, l2 = max(config.strength, 0.0) * min(max(config.mix, 0.0), 1.0), max(config.strength, 0.0) * (1 - min(max(config.mix, 0.0), 1.0))
    rows = design.rows.groupBy("label", "x").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.select("label", F.concat("x", F.array(F.col("n").cast("double"))).alias("x")), "distinct")
    weighted = Design(rows, (*design.columns, "n"))
    n, largest = rows.agg(F.sum(F.element_at("x", -1)), F.max(F.aggregate(F.slice("x", 1, width), F.lit(0.0), lambda s, v: s + v * v))).first()
    step = config.step_scale / max(0.25 * largest + l2, 1e-8)
    beta, converged, rounds = np.zeros(width), False, 0
    while rounds < config.max_iter and not converged:
        rounds += 1

        def gradient(y: np.ndarray, x: np.ndarray, beta: np.ndarray = beta) -> np.ndarray:
            z = x[:, :-1]
            return z.T @ (x[:, -1] * (clipped_sigmoid(z @ beta, config.clip) - y))

        slope = sums(weighted, gradient) / n
        moved = beta - step * (slope + np.where(free, 0.0, l2 * beta))
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0.0)
        after = np.where(free, moved, shrunk)
        converged = bool(np.max(np.abs(after - beta)) <= config.tolerance)
        beta = after
    return Fit(tuple(beta.tolist()), converged, rounds)


def prepare_propensity(anchors: DataFrame, candidates: DataFrame, config: PropensityConfig = PropensityConfig(), id_col: str = "id", column: str = "covariates") -> Propensity:
    """Fit how covariates tell anchors from candidates, and make a score config of the fit."""
    design = design_matrix(anchors, candidates, config.encoding, id_col, column)
    fit = fit_elastic_net(design, config.estimator) if isinstance(config.estimator, ElasticNet) else fit_logit(design, config.estimator)
    linear = F.lit(0.0)
    for k, b in enumerate(fit.coefficients):
        linear = linear + F.get("x", F.lit(k)) * F.lit(b)
    e = F.exp(-F.abs("linear_predictor"))
    p = F.when(F.col("linear_predictor") >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
    clip = config.estimator.clip
    scores = design.rows.select("id", "label", linear.alias("linear_predictor")).withColumn("probability", F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip)))
    scores = written(scores.withColumn("distance_score", F.col("probability" if config.scale is Scale.PROBABILITY else "linear_predictor")), "scores")
    return Propensity(scores, design.columns, fit, config.estimator.name, DistanceConfig.propensity(scores.select("id", "distance_score"), config.caliper))


def covariance(design: Design, over: CovarianceOf) -> np.ndarray:
    """Sample covariance of all rows, or the plain average of both groups'; a group of one contributes zeros.

    Two passes: means, then products of what is left of them.
    """
    width = len(design.columns)
    groups = (1.0, 0.0) if over is CovarianceOf.WITHIN_GROUPS else (None,)
    mine = lambda y, g: np.ones(len(y), bool) if g is None else y == g
    first = sums(design, lambda y, x: np.concatenate([np.r_[mine(y, g).sum(), x[mine(y, g)].sum(axis=0)] for g in groups])).reshape(len(groups), -1)
    means = [f[1:] / max(f[0], 1) for f in first]

    def products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        parts = []
        for g, m in zip(groups, means, strict=True):
            z = x[mine(y, g)] - m
            parts.append((z.T @ z).ravel())
        return np.concatenate(parts)

    found = sums(design, products).reshape(len(groups), width, width)
    each = [f / (n - 1) if n > 1 else np.zeros_like(f) for f, n in zip(found, first[:, 0], strict=True)]
    return sum(each) / len(each)


def prepare_mahalanobis(anchors: DataFrame, candidates: DataFrame, config: MahalanobisConfig = MahalanobisConfig(), caliper: DistanceCaliper | None = None, id_col: str = "id", column: str = "covariates") -> Mahalanobis:
    """Vectors of the encoded covariates (or their ranks) and the inverse of their covariance, as a distance config."""
    encoding = config.encoding
    design = design_matrix(anchors, candidates, type(encoding)(encoding.keys, False, encoding.drop_first_level, encoding.missing), id_col, column)
    if config.transform is Transformed.RANK:
        design = ranked(design)
    cov = covariance(design, config.covariance)
    inverse = inverse_with_ridge(cov, config.ridge, config.attempts)
    vectors = design.rows.select("id", F.col("x").alias("vector"))
    try:
        made = DistanceConfig.mahalanobis(vectors, inverse.ravel().tolist(), len(design.columns), caliper)
    except MahalanobisError as e:
        raise EstimationError(BAD_DISTANCE) from e
    return Mahalanobis(vectors, tuple(inverse.ravel().tolist()), tuple(cov.ravel().tolist()), design.columns, made)


def estimate_propensity_and_match(
    anchors: DataFrame,
    candidates: DataFrame,
    schema: CohortSchema,
    criteria: MatchingCriteria = MatchingCriteria(),
    strategy: Strategy = nearest_birth_date,
    fallback: Sequence[MatchRatio] = (),
    constraints: Sequence[Constraint] = (),
    config: PropensityConfig = PropensityConfig(),
    column: str = "covariates",
) -> tuple[Outcome, Propensity]:
    """Match by scores that are estimated from the same records."""
    found = prepare_propensity(anchors, candidates, config, schema.id, column)
    return match_standard(anchors, candidates, schema, criteria, strategy, fallback, found.config, constraints), found
