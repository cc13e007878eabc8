from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairwell.functions.distance import DistanceConfig
from pairwell.operators import acceptance, diagnostics
from pairwell.operators.constraints import caliper, date_window, gender_match, must_be_alive, must_be_resident
from pairwell.operators.matching import in_order, match_standard, random_order
from pairwell.plans.spec import BirthWindowDays, DistanceCaliper, Estimand, MatchingCriteria, MatchRatio, SpecError
from pairwell.sources.cohort import CohortSchema

DDL = "id string, birth_date date, s string, u string"
SCHEMA = CohortSchema(strata=["s"], unique_key="u", order="id")


def people(rng, n, first, days=40):
    day = lambda: dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(days))
    return [(f"{first}{i:03d}", day(), rng.choice(["x", "y", None]), rng.choice(["f1", "f2", "f3", None])) for i in range(n)]


def serial(anchors, candidates, ratio, window, unique=False, steps=None, replacement=False, caliper=None, scores=None):
    """The serial pass, and the counts it makes on its way."""
    used, values, out, n = set(), set(), set(), {}
    bump = lambda k: n.__setitem__(k, n.get(k, 0) + 1)
    for a in sorted(anchors):
        free = []
        days = lambda c: abs((c[1] - a[1]).days)
        pool = candidates if caliper is not None else [c for c in candidates if c[2] == a[2] and days(c) <= window]
        for c in pool:
            if not replacement and (a[2], c[0]) in used:
                bump("used_control_replacement_disabled")
            elif a[0] == c[0]:
                bump("self_match")
            elif c[2] != a[2]:
                bump("strata_mismatch")
            elif unique and c[3] is not None and (a[2], c[3]) in values:
                bump("unique_key_reused")
            elif caliper is not None and (a[0] not in scores or c[0] not in scores or abs(scores[a[0]] - scores[c[0]]) > caliper):
                bump("propensity_score_caliper")
            else:
                free.append(c)
        free.sort(key=lambda c: (days(c), c[0]))
        if not free:
            bump("none")
            continue
        want = min(ratio, len(free)) if steps is None else next((k for k in steps if k <= len(free)), 0)
        if not want or (steps is None and len(free) < ratio):
            bump("below")
        for c in free[:want]:
            out.add((a[0], c[0]))
            used.add((a[2], c[0]))
            values.add((a[2], c[3]))
    return out, n


def pairs(outcome):
    return {(r.anchor_id, r.candidate_id) for r in outcome.pairs.collect()}


def excluded(outcome):
    return {r.reason: r.n for r in outcome.exclusions().collect()}


def split(n):
    counts = dict(n)
    return counts.pop("none", 0), counts.pop("below", 0), counts


@pytest.mark.parametrize(("seed", "unique", "steps", "block"), [(1, False, None, 10**6), (2, True, None, 10**6), (3, False, (3, 1), 10**6), (4, True, (3, 1), 10**6), (5, False, None, 12), (6, True, None, 12)])
def test_greedy_and_its_counts_equal_a_serial_loop(spark, monkeypatch, seed, unique, steps, block):
    monkeypatch.setattr(acceptance, "BLOCK", block)  # 12: many blocks, which have to agree
    monkeypatch.setattr(acceptance, "LISTED", 1)
    monkeypatch.setattr(acceptance, "LISTED_LEAST", 1)  # lists run out and grow
    monkeypatch.setattr(acceptance, "TURN", 7)
    rng = random.Random(seed)
    a, c = people(rng, 20, "a"), people(rng, 30, "c")
    a[3] = ("c004", *a[3][1:])  # also a candidate
    criteria = MatchingCriteria(birth_window_days=10, ratio=2, required_strata=("s",), unique_by_key="family" if unique else None)
    got = match_standard(spark.createDataFrame(a, DDL), spark.createDataFrame(c, DDL), SCHEMA, criteria, fallback=[MatchRatio(k) for k in steps or ()])
    want, counts = serial(a, c, 2, 10, unique, steps)
    assert pairs(got) == want
    none, below, reasons = split(counts)
    d = got.diagnostics
    assert (d.total_anchors_evaluated, d.matched_anchors, d.pairs_selected) == (20, len({x for x, _ in want}), len(want))
    assert (d.anchors_with_no_candidates, d.anchors_below_required_ratio, d.used_controls) == (none, below, len({y for _, y in want}))
    assert excluded(got) == reasons
    assert d.realized_estimand is (Estimand.ATM if none or below else Estimand.ATT)


@pytest.mark.parametrize(("seed", "unique", "replacement"), [(7, False, False), (8, True, False), (9, True, True), (10, False, True)])
def test_score_calipers_and_counts_without_building_all_pairs(spark, seed, unique, replacement):
    rng = random.Random(seed)
    a, c = people(rng, 15, "a"), people(rng, 25, "c")
    a[3] = ("c004", *a[3][1:])
    scores = {r[0]: rng.random() for r in a + c if rng.random() < 0.9}
    config = DistanceConfig.propensity(spark.createDataFrame(list(scores.items()), "id string, score double"), DistanceCaliper(0.2))
    criteria = MatchingCriteria(ratio=2, required_strata=("s",), unique_by_key="family" if unique else None, allow_replacement=replacement)
    got = match_standard(spark.createDataFrame(a, DDL), spark.createDataFrame(c, DDL), SCHEMA, criteria, config=config)
    want, counts = serial(a, c, 2, None, unique, replacement=replacement, caliper=0.2, scores=scores)
    assert pairs(got) == want
    assert excluded(got) == split(counts)[2]


def test_anchors_with_an_undefined_score_lose_the_whole_pool(spark):
    a = spark.createDataFrame([("a1", dt.date(2010, 1, 1), None, None)], DDL)
    c = spark.createDataFrame([("c1", dt.date(2010, 1, 1), None, None), ("c2", dt.date(2010, 1, 1), None, None)], DDL)
    scores = spark.createDataFrame([("a1", float("nan")), ("c1", 0.5)], "id string, score double")
    got = match_standard(a, c, SCHEMA, config=DistanceConfig.propensity(scores, DistanceCaliper(0.5)))
    assert [(r.category, r.reason, r.n) for r in got.exclusions().collect()] == [("distance_caliper", "propensity_score_caliper", 2)]
    assert got.diagnostics.drift_reasons == ("unmatched_anchors", "distance_caliper_exclusion")


def test_strict_ratios_that_none_reach_count_as_below(spark):
    rows = [(f"{k}{i}", dt.date(2010, 1, 1), None, None) for k in "ac" for i in range(2)]
    frame = spark.createDataFrame(rows, DDL)
    for replacement in (False, True):
        got = match_standard(frame.where("id like 'a%'"), frame.where("id like 'c%'"), SCHEMA, MatchingCriteria(allow_replacement=replacement), fallback=[MatchRatio(3)])
        assert (got.diagnostics.anchors_below_required_ratio, got.diagnostics.pairs_selected) == (2, 0)
        assert got.diagnostics.realized_estimand is Estimand.ATM


def test_with_replacement_anchors_that_reach_selection_count_twice(spark):
    rows = [("a1", dt.date(2010, 1, 1), None, None), ("a2", dt.date(2012, 1, 1), None, None)]
    c = spark.createDataFrame([("c1", dt.date(2010, 1, 2), None, None)], DDL)
    got = match_standard(spark.createDataFrame(rows, DDL), c, SCHEMA, MatchingCriteria(allow_replacement=True)).diagnostics
    assert (got.total_anchors_evaluated, got.unmatched_anchors, got.used_controls, got.drift_reasons) == (3, 0, 0, ())


def test_constraints_name_the_first_that_fails(spark):
    ddl = "id string, birth_date date, gender string, weight double, seen date, death date, event date, until date"
    day = dt.date
    anchor = spark.createDataFrame([("a", day(2010, 1, 1), "f", 3.0, day(2015, 1, 1), None, day(2012, 1, 1), None)], ddl)
    rows = [
        ("ok", day(2010, 1, 1), "f", 3.5, day(2015, 1, 9), day(2013, 1, 1), None, None),
        ("man", day(2010, 1, 1), "m", 3.0, day(2015, 1, 1), None, None, None),
        ("unknown", day(2010, 1, 1), None, 3.0, day(2015, 1, 1), None, None, None),
        ("heavy", day(2010, 1, 1), "f", 9.0, day(2015, 1, 1), None, None, None),
        ("nan", day(2010, 1, 1), "f", float("nan"), day(2015, 1, 1), None, None, None),
        ("late", day(2010, 1, 1), "f", 3.0, day(2015, 2, 1), None, None, None),
        ("dead", day(2010, 1, 1), "f", 3.0, day(2015, 1, 1), day(2012, 1, 1), None, None),
        ("moved", day(2010, 1, 1), "f", 3.0, day(2015, 1, 1), None, None, day(2011, 1, 1)),
    ]
    schema = CohortSchema(death_date="death", event_date="event")
    some = [gender_match(), caliper("weight", 1.0), date_window("seen", 10), must_be_alive(), must_be_resident(lambda c, d: c("until").isNull() | (c("until") > d))]
    got = match_standard(anchor, spark.createDataFrame(rows, ddl), schema, MatchingCriteria(ratio=9), constraints=some)
    assert pairs(got) == {("a", "ok")}
    assert excluded(got) == {"gender_mismatch": 2, "caliper_mismatch": 2, "date_window_mismatch": 1, "control_not_alive_at_index_date": 1, "control_non_resident_at_index_date": 1}
    known = match_standard(anchor, spark.createDataFrame(rows, ddl), schema, MatchingCriteria(ratio=9), constraints=[gender_match(allow_unknown=True)])
    assert ("a", "unknown") in pairs(known)


def test_random_order_is_seeded_and_never_reuses(spark):
    rng = random.Random(11)
    a, c = (spark.createDataFrame(people(rng, n, k), DDL) for n, k in ((20, "i"), (40, "i")))
    runs = [match_standard(a, c, SCHEMA, MatchingCriteria(birth_window_days=365, ratio=2), strategy=random_order(seed)).pairs.collect() for seed in (1, 1, 2)]
    first, again, other = ({(r.anchor_id, r.candidate_id) for r in x} for x in runs)
    assert first == again != other
    assert all(x != y for x, y in first | other)
    assert len({y for _, y in first}) == len(first)


def test_empty_and_invalid_inputs_give_no_pairs(spark):
    some, none = spark.createDataFrame(people(random.Random(5), 3, "a"), DDL), spark.createDataFrame([], DDL)
    assert match_standard(some, none, SCHEMA, strategy=in_order).pairs.count() == 0
    assert match_standard(none, some, SCHEMA, fallback=[MatchRatio(2)]).pairs.count() == 0
    bad = match_standard(some, some, SCHEMA, MatchingCriteria(ratio=0))
    assert bad.pairs.count() == 0
    assert (bad.diagnostics.total_anchors_evaluated, bad.diagnostics.unmatched_anchors, dict(bad.diagnostics.refused)) == (3, 3, {"invalid_criteria:zero_match_ratio": 1})
    assert excluded(bad) == {"invalid_criteria:zero_match_ratio": 1}


def test_diagnostics_merge():
    a = diagnostics.MatchDiagnostics(total_anchors_evaluated=2, matched_anchors=1, pairs_selected=3, drift_reasons=("unmatched_anchors",))
    b = diagnostics.MatchDiagnostics(total_anchors_evaluated=5, matched_anchors=2, pairs_selected=2, drift_reasons=("unmatched_anchors", "ratio_shortfall"))
    both = a.merge(b)
    assert (both.total_anchors_evaluated, both.matched_anchors, both.drift_reasons) == (7, 3, ("unmatched_anchors", "ratio_shortfall"))
    assert both.avg_controls_per_case == 5 / 3


def test_values_are_checked():
    for make, bad in ((MatchRatio, 0), (BirthWindowDays, -1), (DistanceCaliper, float("inf"))):
        with pytest.raises(SpecError):
            make(bad)
    with pytest.raises(TypeError):
        MatchRatio("2")


def test_the_band_is_a_key_of_the_join(spark):
    a = spark.createDataFrame(people(random.Random(1), 5, "a"), DDL)
    got = match_standard(a, a, SCHEMA, MatchingCriteria(required_strata=("s",)))
    plan = got.edges.where(F.col("reason").isNull())._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]
