from __future__ import annotations

import datetime as dt
import random

import pytest

from pairwell.functions.distance import DistanceConfig
from pairwell.operators.transition import match_transition
from pairwell.plans.spec import AgeLimitYears, CommonSupport, DistanceCaliper, Estimand, MatchingCriteria, MatchRatio, TransitionOptions
from pairwell.sources.cohort import CohortSchema

DDL = "id string, birth_date date, s string, u string, event date"
SCHEMA = CohortSchema(strata=["s"], unique_key="u", event_date="event")
D = dt.date


def members(rng, n):
    out = []
    for i in range(n):
        birth = D(2010, 1, 1) + dt.timedelta(days=rng.randrange(300))
        event = rng.choice([None, 2, 4, 7])
        out.append((f"p{i:02d}", birth, rng.choice(["x", "y"]), rng.choice(["f1", "f2", None]), event and D(birth.year + event, birth.month, min(birth.day, 28)) + dt.timedelta(days=rng.randrange(20))))
    return out


def serial(rows, ratio, window=None, unique=False, steps=None, scores=None, caliper=None, policy=None):
    """The loop over cases in order of event and id, and what it counts."""
    old = lambda r: D(r[1].year + 6, r[1].month, min(r[1].day, 28))
    cases = sorted((r for r in rows if r[4] and r[4] < old(r)), key=lambda r: (r[4], r[0]))
    trimmed, low, high = set(), None, None
    if policy:
        mine = [scores[r[0]] for r in cases if r[0] in scores]
        low, high = min(mine), max(mine)
        trimmed = {r[0] for r in rows if r[0] not in scores or not low <= scores[r[0]] <= high}
    used, values, out, n = set(), set(), set(), {}
    bump = lambda k: n.__setitem__(k, n.get(k, 0) + 1)
    for a in cases:
        if policy in ("Treated", "Both") and a[0] in trimmed:
            continue
        free = []
        pool = rows if scores is not None else [c for c in rows if c[2] == a[2] and abs((c[1] - a[1]).days) <= window]
        for c in pool:
            if (c[4] and c[4] <= a[4]) or (policy in ("Control", "Both") and c[0] in trimmed):
                bump("additional_filter")
            elif c[0] in used:
                bump("used_control_replacement_disabled")
            elif c[2] != a[2]:
                bump("strata_mismatch")
            elif unique and c[3] and c[3] in values:
                bump("unique_key_reused")
            elif scores is not None and (a[0] not in scores or c[0] not in scores or abs(scores[a[0]] - scores[c[0]]) > caliper):
                bump("propensity_score_caliper")
            else:
                free.append(c)
        free.sort(key=lambda c: (abs((c[1] - a[1]).days), c[0]))
        if not free:
            bump("none")
            continue
        want = min(ratio, len(free)) if steps is None else next((k for k in steps if k <= len(free)), 0)
        if not want or (steps is None and len(free) < ratio):
            bump("below")
        for c in free[:want]:
            out.add((a[0], c[0]))
            used.add(c[0])
            values.add(c[3])
    return out, n


@pytest.mark.parametrize(("seed", "unique", "steps", "policy"), [(1, False, None, None), (2, True, None, None), (3, True, (2,), None), (4, False, None, "Both"), (5, True, None, "Control")])
def test_cases_are_served_as_in_the_serial_loop(spark, seed, unique, steps, policy):
    rng = random.Random(seed)
    rows = members(rng, 28)
    scores = {r[0]: rng.random() for r in rows if rng.random() < 0.9} if policy else None
    config = policy and DistanceConfig.propensity(spark.createDataFrame(list(scores.items()), "id string, score double"), DistanceCaliper(0.3))
    criteria = MatchingCriteria(birth_window_days=120, ratio=2, required_strata=("s",), unique_by_key="family" if unique else None, common_support=CommonSupport(policy) if policy else None)
    options = TransitionOptions(ratio_fallback=tuple(MatchRatio(k) for k in steps or ()))
    got = match_transition(spark.createDataFrame(rows, DDL), SCHEMA, criteria, options, config=config)
    want, n = serial(rows, 2, 120, unique, steps, scores, 0.3, policy)
    assert {(r.anchor_id, r.candidate_id) for r in got.pairs.collect()} == want
    none, below = n.pop("none", 0), n.pop("below", 0)
    assert {r.reason: r.n for r in got.exclusions().collect()} == n
    assert (got.diagnostics.anchors_with_no_candidates, got.diagnostics.anchors_below_required_ratio) == (none, below)


def test_partial_and_strict_ratios(spark):
    rows = [("a", D(2010, 1, 1), None, None, D(2012, 1, 1)), ("b", D(2010, 1, 5), None, None, None)]
    frame = spark.createDataFrame(rows, DDL)
    partial = match_transition(frame, SCHEMA, MatchingCriteria(ratio=2)).diagnostics
    strict = match_transition(frame, SCHEMA, MatchingCriteria(ratio=2), TransitionOptions(ratio_fallback=(MatchRatio(2),))).diagnostics
    assert (partial.pairs_selected, partial.anchors_below_required_ratio, strict.pairs_selected, strict.anchors_below_required_ratio) == (1, 1, 0, 1)


def test_a_score_config_switches_the_window_off(spark):
    rows = [("a", D(2010, 1, 1), None, None, D(2012, 1, 1)), ("b", D(2010, 7, 1), None, None, None)]
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.24)], "id string, score double")
    got = match_transition(spark.createDataFrame(rows, DDL), SCHEMA, MatchingCriteria(birth_window_days=0), config=DistanceConfig.propensity(scores, DistanceCaliper(0.05)))
    assert got.pairs.count() == 1


def test_support_needs_scores_and_trims(spark):
    rows = [("a", D(2010, 1, 1), None, None, D(2012, 1, 1)), ("b", D(2010, 1, 2), None, None, None), ("c", D(2010, 1, 3), None, None, None)]
    frame = spark.createDataFrame(rows, DDL)
    none = match_transition(frame, SCHEMA, MatchingCriteria(common_support=CommonSupport.BOTH))
    assert [r.reason for r in none.exclusions().collect()] == ["common_support_failure:requires_propensity_score_map"]
    assert none.diagnostics.total_anchors_evaluated == 1
    scores = spark.createDataFrame([("a", 0.35), ("b", 0.35), ("c", 0.9)], "id string, score double")
    got = match_transition(frame, SCHEMA, MatchingCriteria(ratio=2, common_support=CommonSupport.CONTROL), config=DistanceConfig.propensity(scores, DistanceCaliper(1.0)))
    d = got.diagnostics
    assert (got.pairs.count(), d.trimmed_candidates, d.anchor_bounds, d.candidate_bounds, d.realized_estimand) == (1, 1, (0.35, 0.35), (0.35, 0.9), Estimand.ATM)
    assert d.drift_reasons[0] == "common_support_trimming"
    far = spark.createDataFrame([("a", float("nan")), ("b", 0.35)], "id string, score double")
    bad = match_transition(frame, SCHEMA, MatchingCriteria(common_support=CommonSupport.BOTH), config=DistanceConfig.propensity(far, DistanceCaliper(1.0)))
    assert [r.reason for r in bad.exclusions().collect()] == ["common_support_failure:no_overlap"]


def test_the_age_limit_clamps_month_ends(spark):
    rows = [("a", D(2012, 2, 29), None, None, D(2013, 2, 27)), ("b", D(2012, 2, 29), None, None, D(2013, 2, 28)), ("c", D(2012, 2, 28), None, None, None)]
    got = match_transition(spark.createDataFrame(rows, DDL), SCHEMA, MatchingCriteria(), TransitionOptions(age_limit=AgeLimitYears(1)))
    assert got.anchors.count() == 1
