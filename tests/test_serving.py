"""Serving from records must equal the passes over edges, and must not build edges."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from pairwell.functions.distance import DistanceConfig
from pairwell.operators import diagnostics
from pairwell.operators.acceptance import TAKEN
from pairwell.operators.candidates import eligible
from pairwell.operators.constraints import Constraint
from pairwell.operators.matching import in_order, match_standard, nearest_birth_date, random_order, resource, select_pairs
from pairwell.operators.serving import _Draws, dominated
from pairwell.plans.spec import DistanceCaliper, MatchingCriteria, MatchRatio
from pairwell.sources.cohort import CohortSchema

SCHEMA = CohortSchema(id="id", birth_date="born", strata={"town": "town"}, unique_key="family")
DDL = "id string, born date, town string, family string, score double"


def people(seed: int, n: int, days: int, prefix: str, families: int = 9):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.04 else dt.date(2010, 1, 1) + dt.timedelta(rng.randrange(days))
    family = lambda: rng.choice([None, *(str(k) for k in range(families))])
    ids = rng.sample(range(3 * n), n)
    return [(f"{rng.choice(prefix)}{i}", day(), rng.choice(["x", "y", None]), family(), rng.choice([None, float("nan"), *(rng.randrange(40) / 4 for _ in range(8))])) for i in ids]


def sides(spark, seed, n=60, days=25, families=9):
    return (spark.createDataFrame(people(seed + k, n, days, "pq", families), DDL) for k in (0, 1000))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ORDERS = {"nearest": nearest_birth_date, "in_order": in_order, "random": random_order(3)}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("unique", [None, "family"])
@pytest.mark.parametrize("scored", [False, True])
@pytest.mark.parametrize("order", sorted(ORDERS))
def test_records_are_served_as_edges_are(spark, seed, unique, scored, order):
    a, c = sides(spark, seed)
    config = DistanceConfig.propensity(a.unionByName(c).select("id", "score"), DistanceCaliper(1.5)) if scored else None
    fallback = (MatchRatio(3), MatchRatio(1)) if seed == 2 else ()
    criteria = MatchingCriteria(birth_window_days=4, ratio=2, required_strata=("town",), unique_by_key=unique)
    got = match_standard(a, c, SCHEMA, criteria, ORDERS[order], fallback, config)
    assert sorted(map(str, got.selected.collect())) == sorted(map(str, serial(got, ORDERS[order]())))


def serial(got, order) -> list:
    """What a loop over the sorted edges takes."""
    place = F.row_number().over(Window.partitionBy("a_ord", "a_id").orderBy(*order))
    able = eligible(got.edges).withColumn("r", resource(got.criteria, F.col("grp"))).withColumn("place", place)
    edges = sorted(able.collect(), key=lambda e: (e.a_ord, e.a_id, e.place))
    used, out = set(), []
    for _, mine in groupby(edges, key=lambda e: (e.a_ord, e.a_id)):
        free = [e for e in mine if e.r not in used]
        took = free[: got.policy.target(len(free)) or 0]
        used |= {e.r for e in took if e.r is not None}
        out += [Row(**{c: e[c] for c in TAKEN}) for e in took]
    assert len(out) > 10
    return out


def test_passes_over_edges_remain_for_conditions_of_a_runs_own(spark):
    a, c = sides(spark, 4)
    criteria = MatchingCriteria(birth_window_days=4, ratio=2, required_strata=("town",))
    got = match_standard(a, c, SCHEMA, criteria, constraints=[Constraint("other", lambda x, y: x("id") != F.concat(y("id"), F.lit("1")))])
    assert sorted(map(str, got.selected.collect())) == sorted(map(str, serial(got, nearest_birth_date())))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("steps", [(), (3, 1)])
def test_lists_of_a_day_are_what_each_anchor_would_choose(spark, seed, steps):
    a, c = sides(spark, seed)
    criteria = MatchingCriteria(birth_window_days=4, ratio=2, required_strata=("town",), allow_replacement=True)
    got = match_standard(a, c, SCHEMA, criteria, fallback=[MatchRatio(s) for s in steps])
    want = select_pairs(got.edges, got.anchors, criteria, got.policy, nearest_birth_date(), F.col("grp"), False)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got.selected) == rows(want)
    assert got.selected.where("a_id = c_id").isEmpty()


@pytest.mark.parametrize("strategy", [nearest_birth_date, random_order(5)])
def test_a_crowded_day_is_served_without_edges(spark, strategy):
    """3000 anchors and 3000 candidates of one day and stratum: nine million edges, of which lists would hold the same few."""
    who = lambda p: spark.range(3000).select(F.concat(F.lit(p), F.lpad("id", 5, "0")).alias("id"), F.lit("2010-01-01").cast("date").alias("born"), F.lit("x").alias("town"), F.lit(None).cast("string").alias("family"))
    got = match_standard(who("a"), who("c"), SCHEMA, MatchingCriteria(birth_window_days=30, ratio=2, required_strata=("town",)), strategy)
    assert "Join" not in plan(got.select())
    pairs = [(r.a_id, r.c_id) for r in got.selected.orderBy("a_id", "c_id").collect()]
    assert [a for a, _ in pairs] == [f"a{k // 2:05}" for k in range(3000)]
    if strategy is nearest_birth_date:
        assert [c for _, c in pairs] == [f"c{k:05}" for k in range(3000)]


def test_with_replacement_a_crowded_day_gives_one_list(spark):
    who = lambda p: spark.range(3000).select(F.concat(F.lit(p), F.lpad("id", 5, "0")).alias("id"), F.lit("2010-01-01").cast("date").alias("born"), F.lit("x").alias("town"), F.lit(None).cast("string").alias("family"))
    got = match_standard(who("a"), who("c"), SCHEMA, MatchingCriteria(birth_window_days=30, ratio=2, required_strata=("town",), allow_replacement=True))
    joined = got.select()
    joined.collect()
    most = max(int(x.split(": ")[1].replace(",", "")) for x in metric_rows(joined))
    assert most <= 6000
    assert {(r.a_id, r.c_id) for r in got.selected.collect()} == {(f"a{k:05}", f"c{j:05}") for k in range(3000) for j in range(2)}


def metric_rows(df) -> list[str]:
    """Output rows of every step of a plan that has run."""
    out: list[str] = []

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            out.append(f"{name}: {found.get().value()}")
        for child in [inner] if inner is not None else [node.children().apply(k) for k in range(node.children().size())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("unique", [None, "family"])
@pytest.mark.parametrize("replacement", [False, True])
def test_exclusions_of_a_window_are_counted_without_pairs(spark, monkeypatch, seed, unique, replacement):
    a, c = sides(spark, seed)
    criteria = MatchingCriteria(birth_window_days=4, ratio=2, required_strata=("town",), unique_by_key=unique, allow_replacement=replacement)
    got = match_standard(a, c, SCHEMA, criteria)
    want = {k: n for k, n in diagnostics._counted(diagnostics.classified(got, got.edges)).items() if n}
    monkeypatch.setattr(diagnostics, "classified", lambda *_: pytest.fail("pairs were built"))
    assert {(r.category, r.reason.split(":")[-1]): r.n for r in got.exclusions().collect()} == want
    assert want


def test_questions_of_rank_and_place():
    rng = np.random.default_rng(1)
    rank, low, than = rng.permutation(50), rng.integers(0, 40, 30), rng.integers(-1, 50, 30)
    high = low + rng.integers(0, 10, 30)
    assert dominated(rank, low, high, than).tolist() == [int((rank[x:y] > t).sum()) for x, y, t in zip(low, high, than, strict=True)]


@pytest.mark.parametrize("longest", [9, 70])
def test_digests_of_many_pairs_at_once(longest):
    ids = [("é" if k % 2 else "c") * (1 + k % longest) + str(k) for k in range(200)]
    draws = _Draws("11", pa.chunked_array([ids]))
    got = draws.words("a7", np.arange(200))
    want = [hashlib.md5(f"11:a7:{i}".encode()).hexdigest() for i in ids]
    assert ["".join(f"{int(x):08x}" for x in w) for w in got.T] == want
