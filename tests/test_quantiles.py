"""Quantile distances from counts: over many stretches, and without a row for each record."""

from __future__ import annotations

import random

import pytest
from test_balance import by_hand

from pairwell.operators import balance
from pairwell.operators.balance import eqq_distances
from pairwell.functions.running import running_counts
from pyspark.sql import functions as F


def distances(spark, case: list[float], control: list[float]):
    rows = [("v", "pre", x, case.count(x), control.count(x)) for x in {*case, *control}]
    counted = spark.createDataFrame(rows, "covariate string, phase string, x double, k_case long, k_control long")
    return eqq_distances(running_counts(counted, ["covariate", "phase"], "x", {c: F.col(c) for c in ("k_case", "k_control")}), ["covariate", "phase"])


@pytest.mark.parametrize("size", [1, 3, 7])
@pytest.mark.parametrize(("n1", "n0", "values"), [(13, 30, 5), (31, 12, 10**6), (1, 9, 4), (9, 1, 10**6), (8, 8, 3), (20, 19, 10**6), (1, 1, 9), (2, 40, 2)])
def test_stretches_add_up(spark, monkeypatch, size, n1, n0, values):
    monkeypatch.setattr(balance, "STRETCH", size)
    rng = random.Random(n1 * 37 + n0 + size)
    case, control = ([float(rng.randrange(values)) for _ in range(n)] for n in (n1, n0))
    got = distances(spark, case, control).first()
    assert (got.eqq_mean, got.eqq_max) == pytest.approx(by_hand(case, control)[2:])


def test_a_value_of_many_records_is_one_row_until_it_is_compared(spark):
    """Two million records of two values each were two million rows of shuffles and files."""
    rows = [("v", "pre", 0.0, 1_500_000, 500_000), ("v", "pre", 1.0, 500_000, 1_500_000)]
    counted = spark.createDataFrame(rows, "covariate string, phase string, x double, k_case long, k_control long")
    got = eqq_distances(running_counts(counted, ["covariate", "phase"], "x", {c: F.col(c) for c in ("k_case", "k_control")}), ["covariate", "phase"])
    r = got.first()
    assert (round(r.eqq_mean, 5), r.eqq_max) == (0.5, 1.0)
    tracker = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in tracker and "Window" in tracker


def test_only_the_half_of_a_report_that_is_asked_for_is_computed(spark, monkeypatch):
    monkeypatch.setattr(balance, "numeric_balance", lambda *_: pytest.fail("numbers were not asked for"))
    cells = F.create_map(F.lit("sex"), F.struct(F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit("m").alias("cat")), F.lit("age"), F.struct(F.lit("numeric").alias("kind"), F.lit(3.0).alias("num"), F.lit(None).cast("string").alias("cat")))
    who = spark.range(3).select(F.col("id").cast("string").alias("id"), cells.alias("covariates"))
    got = balance.balance_report(who, who, spark.createDataFrame([], "anchor_id string, candidate_id string"))
    assert got.categorical.first().level == "m"
