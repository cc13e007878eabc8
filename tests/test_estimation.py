from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.functions.covariates import covariates
from pairwell.functions.distance import DistanceConfig, MahalanobisError, quadratic_form
from pairwell.operators.design import design_matrix, ranked
from pairwell.operators.estimation import covariance, estimate_propensity_and_match, inverse_with_ridge, prepare_mahalanobis, prepare_propensity, solve_with_ridge
from pairwell.operators.matching import match_standard
from pairwell.plans.estimation import CovarianceOf, ElasticNet, Encoding, EstimationError, MahalanobisConfig, MissingPolicy, PropensityConfig, Scale, Transformed
from pairwell.plans.spec import DistanceCaliper, MatchingCriteria
from pairwell.sources.cohort import CohortSchema


def frame(spark, rows, ddl="id string, age double, place string"):
    columns = [c.split()[0] for c in ddl.split(", ")]
    numeric = [c for c in columns[1:] if c != "place"]
    return spark.createDataFrame(rows, ddl).withColumn("covariates", covariates(numeric, ["place"] if "place" in columns else []))


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)
    make = lambda k, n, shift: frame(spark, [(f"{k}{i}", float(rng.normal(shift)), rng.choice(["n", "s", "w"])) for i in range(n)])
    return make("a", 40, 0.7), make("c", 60, 0.0)


def by_hand(sides):
    rows = [(r.label, r.x) for r in design_matrix(*sides, Encoding(intercept=True)).rows.collect()]
    return np.array([y for y, _ in rows]), np.array([x for _, x in rows])


def test_logit_equals_newton(spark, sides):
    y, x = by_hand(sides)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        pen = np.diag([0.0] + [1e-6] * (len(beta) - 1))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (y - p) - pen @ beta)
    got = prepare_propensity(*sides)
    assert got.columns == ("intercept", "age", "place=s", "place=w")
    assert got.fit.converged and got.estimator == "glm_logit"
    assert got.fit.coefficients == pytest.approx(beta.tolist(), rel=1e-6)
    r = got.scores.agg(F.avg(F.when(F.col("label") == 1, F.col("probability"))), F.avg(F.when(F.col("label") == 0, F.col("probability")))).first()
    assert r[0] > r[1]


def test_elastic_net_equals_a_loop_and_shrinks(spark, sides):
    y, x = by_hand(sides)
    config = ElasticNet(max_iter=30, strength=0.05)
    step = 1 / (0.25 * (x * x).sum(axis=1).max() + 0.025)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        g = x.T @ (1 / (1 + np.exp(-x @ beta)) - y) / len(y)
        z = beta - step * (g + np.r_[0, 0.025 * beta[1:]])
        beta = np.r_[z[0], np.sign(z[1:]) * np.maximum(abs(z[1:]) - step * 0.025, 0)]
    got = prepare_propensity(*sides, PropensityConfig(estimator=config, scale=Scale.LINEAR_PREDICTOR))
    assert got.fit.coefficients == pytest.approx(beta.tolist(), rel=1e-9)
    assert (got.fit.iterations, got.fit.converged, got.estimator) == (30, False, "elastic_net_logit")
    heavy = prepare_propensity(*sides, PropensityConfig(estimator=ElasticNet(max_iter=20, strength=0.5, mix=1.0)))
    assert sum(map(abs, heavy.fit.coefficients[1:])) < sum(map(abs, prepare_propensity(*sides).fit.coefficients[1:]))
    with pytest.raises(EstimationError, match="invalid_elastic_net_config"):
        prepare_propensity(*sides, PropensityConfig(estimator=ElasticNet(clip=0.75)))


def test_covariances_and_ranks(spark):
    a, c = (frame(spark, [(f"{k}{i}", v) for i, v in enumerate(vs)], "id string, x double") for k, vs in (("a", (0.0, 2.0)), ("c", (10.0, 12.0))))
    d = design_matrix(a, c, Encoding())
    assert covariance(d, CovarianceOf.WITHIN_GROUPS).tolist() == [[2.0]]
    assert covariance(d, CovarianceOf.ALL)[0, 0] == pytest.approx(104 / 3)
    a, c = (frame(spark, rows, "id string, x double, y double") for rows in ([("a1", 5.0, 10.0), ("a2", 5.0, 30.0)], [("c1", 9.0, 20.0)]))
    got = {r.id: r.x for r in ranked(design_matrix(a, c, Encoding())).rows.collect()}
    assert got == {"a1": [1.5, 1.0], "a2": [1.5, 3.0], "c1": [3.0, 2.0]}
    assert prepare_mahalanobis(a, c, MahalanobisConfig(transform=Transformed.RANK)).dimension == 2


def test_mahalanobis_config_matches_within_the_caliper(spark):
    rng = np.random.default_rng(2)
    make = lambda k, n: frame(spark, [(f"{k}{i}", *map(float, rng.normal(size=2))) for i in range(n)], "id string, x double, y double").withColumn("birth_date", F.lit("2010-01-01"))
    a, c = make("a", 12), make("c", 20)
    found = prepare_mahalanobis(a, c, caliper=DistanceCaliper(0.8))
    inverse = np.array(found.inverse_covariance).reshape(2, 2)
    vectors = {r.id: np.array(r.vector) for r in found.vectors.collect()}
    near = lambda x, y: math.sqrt((x - y) @ inverse @ (x - y))
    want = {(p, q) for p in vectors for q in vectors if p[0] == "a" and q[0] == "c" and near(vectors[p], vectors[q]) <= 0.8}
    got = match_standard(a, c, CohortSchema(), MatchingCriteria(ratio=99, allow_replacement=True), config=found.config)
    assert {(r.anchor_id, r.candidate_id) for r in got.pairs.collect()} == want
    assert {r.reason: r.n for r in got.exclusions().collect()} == {"mahalanobis_caliper": 12 * 20 - len(want)}


def test_mahalanobis_values(spark):
    d = spark.range(1).select(quadratic_form(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0)), (1, 0, 0, 1), 2).alias("d"), quadratic_form(F.array(F.lit(1.0)), F.array(F.lit(1.0)), (float("nan"),), 1).alias("n")).first()
    assert (d.d, d.n) == (5.0, None)
    with pytest.raises(MahalanobisError):
        DistanceConfig.mahalanobis(spark.createDataFrame([("a", [1.0])], "id string, v array<double>"), (1, 0, 0), 2)


def test_preprocessing_errors_name_what_is_wrong(spark):
    some = frame(spark, [("a", 1.0, "x"), ("b", 2.0, "y")])
    gap = frame(spark, [("c", None, "x")])
    with pytest.raises(EstimationError, match="missing_values_not_allowed: age"):
        prepare_propensity(some, gap)
    imputed = prepare_propensity(some, gap, PropensityConfig(Encoding(intercept=True, missing=MissingPolicy.IMPUTE)))
    assert imputed.scores.count() == 3
    with pytest.raises(EstimationError, match="empty_input"):
        prepare_propensity(some, some.where("false"))
    with pytest.raises(EstimationError, match="no_observed_values_for_covariate: height"):
        prepare_propensity(some, some, PropensityConfig(Encoding(keys=("height",), intercept=True)))
    mixed = spark.createDataFrame([("c",)], "id string").withColumn("covariates", F.create_map(F.lit("place"), F.struct(F.lit("numeric").alias("kind"), F.lit(1.0).alias("num"), F.lit(None).cast("string").alias("cat"))))
    with pytest.raises(EstimationError, match="mixed_covariate_type: place"):
        design_matrix(some.select("id", "covariates"), mixed, Encoding(keys=("place",), missing=MissingPolicy.IMPUTE))
    nan = spark.createDataFrame([("c",)], "id string").withColumn("covariates", F.create_map(F.lit("age"), F.struct(F.lit("numeric").alias("kind"), F.lit(float("nan")).alias("num"), F.lit(None).cast("string").alias("cat"))))
    with pytest.raises(EstimationError, match="non_finite_numeric_covariate: age: c"):
        design_matrix(some.select("id", "covariates"), nan, Encoding(keys=("age",)))
    same = frame(spark, [("c", 1.0, "x")])
    with pytest.raises(EstimationError, match="no_covariates_available"):
        design_matrix(same, same, Encoding())


def test_solvers_add_a_ridge_where_they_must():
    flat = np.ones((2, 2))
    assert np.isfinite(solve_with_ridge(flat, np.ones(2))).all()
    assert np.isfinite(inverse_with_ridge(flat, 0.0, 8)).all()
    with pytest.raises(EstimationError):
        inverse_with_ridge(np.zeros((1, 1)), 0.0, 1)


def test_estimates_feed_the_matching(spark):
    a = frame(spark, [("a1", 10.0, "n"), ("a2", 11.0, "n")]).withColumn("birth_date", F.lit("2010-01-01"))
    c = frame(spark, [("c1", 1.0, "s"), ("c2", 10.5, "n")]).withColumn("birth_date", F.lit("2011-01-01"))
    outcome, found = estimate_propensity_and_match(a, c, CohortSchema(), MatchingCriteria(birth_window_days=0))
    assert outcome.pairs.count() == 2
    assert found.scores.where("probability > 0 and probability < 1").count() == 4
