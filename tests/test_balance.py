from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairwell.functions.covariates import covariates
from pairwell.job import MatchJob
from pairwell.operators import weights as w
from pairwell.operators.balance import BalanceOptions, balance_diagnostics, balance_report, match_rate
from pairwell.operators.matching import nearest_birth_date
from pairwell.operators.projected import projected_balance
from pairwell.operators.reconstruction import ReconstructionOptions, reconstruct_pairs
from pairwell.plans.spec import BalanceThresholds, BirthWindowDays, Estimand, MatchRatio, Transform
from pairwell.sources import reports
from pairwell.sources.cohort import CohortSchema

D = dt.date
PAIRS = "anchor_id string, candidate_id string"


def records(spark, rows, ddl, numeric=(), categorical=(), absent=False):
    return spark.createDataFrame(rows, ddl).withColumn("covariates", covariates(numeric, categorical, absent))


def quantile(xs, i, d):
    p = i * (len(xs) - 1)
    lo, rest = (p // d, p % d) if len(xs) > 1 else (0, 0)
    return xs[lo] + (rest / d * (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) if rest else 0.0)


def by_hand(case, control):
    """ecdf mean and max, eqq mean and max."""
    case, control = sorted(case), sorted(control)
    support = sorted({*case, *control})
    gaps = [abs(sum(x <= s for x in case) / len(case) - sum(x <= s for x in control) / len(control)) for s in support]
    m = max(len(case), len(control), 2)
    q = [abs(quantile(case, i, m - 1) - quantile(control, i, m - 1)) for i in range(m)]
    return sum(gaps) / len(gaps), max(gaps), sum(q) / m, max(q)


@pytest.mark.parametrize(("n1", "n0", "same"), [(13, 30, False), (30, 13, True), (1, 1, False), (1, 6, False), (2, 1, True), (8, 8, True)])
def test_distances_equal_a_direct_computation(spark, n1, n0, same):
    rng = random.Random(n1 * 31 + n0)
    draw = lambda n: [float(rng.randrange(5)) if same else rng.random() for _ in range(n)]
    case, control = draw(n1), draw(n0)
    a, c = ([(f"{k}{i}", x) for i, x in enumerate(xs)] for k, xs in (("a", case), ("c", control)))
    a, c = (records(spark, rows, "id string, x double", ["x"]) for rows in (a, c))
    r = balance_report(a, c, spark.createDataFrame([], PAIRS)).wide().first()
    assert (r.ecdf_mean_pre, r.ecdf_max_pre, r.eqq_mean_pre, r.eqq_max_pre) == pytest.approx(by_hand(case, control))
    assert (r.smd_post, r.ecdf_max_post, r.eqq_max_post, r.mean_case_post) == (0, 0, 0, 0)


def test_report_over_pairs_levels_and_transforms(spark):
    a = records(spark, [("a", 10.0, "north"), ("b", 30.0, None)], "id string, age double, region string", ["age"], ["region"], absent=True)
    c = records(spark, [("c", 20.0, "south"), ("d", 40.0, "north")], "id string, age double, region string", ["age"], ["region"], absent=True)
    pairs = spark.createDataFrame([("a", "d"), ("a", "d"), ("x", "y")], PAIRS)
    report = balance_report(a, c, pairs, BalanceOptions(Transform.SQUARES_AND_INTERACTIONS))
    rows = {r.covariate: r for r in report.wide().collect()}
    assert list(rows) == ["age", "age^2"]
    assert (rows["age"].mean_case_post, rows["age"].mean_control_post, rows["age^2"].mean_case_pre) == (10.0, 40.0, 500.0)
    levels = {r.level: r for r in report.categorical.collect()}
    # b has no region at all: a row, but of no reported level
    assert set(levels) == {"north", "south"}
    assert (levels["north"].p_case_pre, levels["north"].n_case_post, levels["north"].p_control_post) == (0.5, 2, 1.0)
    explicit = balance_report(records(spark, [("a", None)], "id string, region string", [], ["region"]), records(spark, [("c", "south")], "id string, region string", [], ["region"]), pairs)
    assert {r.level: r.n_case_pre for r in explicit.categorical.collect()} == {"missing": 1, "south": 0}
    assert explicit.wide() is None


def test_supplemental_values_fill_absent_keys_only(spark):
    a = records(spark, [("a", 1.0), ("b", None)], "id string, age double", ["age"], absent=True)
    c = records(spark, [("c", 3.0)], "id string, age double", ["age"])
    more = records(spark, [("a", 9.0, 2.0), ("b", 9.0, 4.0)], "id string, age double, income double", ["age", "income"]).select("id", "covariates")
    report = balance_report(a, c, spark.createDataFrame([], PAIRS), BalanceOptions(Transform.SQUARES_AND_INTERACTIONS, cases_more=more))
    rows = {r.covariate: r.mean_case_pre for r in report.wide().collect()}
    assert rows == {"age": 5.0, "income": 3.0, "age^2": 41.0, "income^2": 10.0, "age * income": 19.0}


def test_a_leading_missing_value_makes_a_covariate_categorical(spark):
    a = records(spark, [("a", None), ("b", 2.0)], "id string, age double", ["age"])
    report = balance_report(a, a, spark.createDataFrame([], PAIRS))
    assert report.numeric is None
    assert [r.level for r in report.categorical.collect()] == ["missing", "numeric"]


def test_thresholds_are_each_optional(spark):
    a, c = (records(spark, [(f"{k}{i}", float(v)) for i, v in enumerate(vs)], "id string, x double", ["x"]) for k, vs in (("a", (1, 1)), ("c", (1, 2))))
    pairs = spark.createDataFrame([("a0", "c0"), ("a1", "c1")], PAIRS)
    report = balance_report(a, c, pairs)
    r = report.wide().first()
    assert (r.variance_ratio_post, r.ecdf_max_post, r.eqq_max_post) == (0.0, 0.5, 1.0)
    one = lambda *limits: report.thresholds(BalanceThresholds(*limits)).first()
    off = one(None, None, None, 0.5, 1.0)
    assert (off.smd_ok, off.ratio_ok, off.ecdf_ok, off.eqq_ok, off.passed, off.all_passed) == (None, None, True, True, True, True)
    assert (one(None, None, 1.0, None, None).passed, one(None, 0.5, None, None, None).passed, one(None, None, None, 0.4, None).all_passed) == (True, False, False)
    assert (BalanceThresholds.strict().smd, BalanceThresholds.lenient().var_ratio_max, BalanceThresholds.moderate()) == (0.05, 1.5, BalanceThresholds())


def test_reports_as_csv(spark, tmp_path):
    a, c = (records(spark, [(f"{k}{i}", D(2010, 1, 1), v, "m") for i, v in enumerate(vs)], "id string, birth_date date, x double, sex string", ["x"], ["sex"]) for k, vs in (("a", (1.0, 1.0)), ("c", (1.0, 2.0))))
    job = MatchJob.standard(a, c, CohortSchema(), 7).with_ratio(MatchRatio(1)).with_birth_window(BirthWindowDays(0)).with_strategy(nearest_birth_date).with_gender_match()
    outcome, report = job.run_with_balance(a, c)
    config = reports.ReportConfig(2, ";", {"x": 6})
    assert reports.NumericBalanceReport(report).render(config).splitlines()[1].startswith("x;1.000000;1.500000;-1.414214;0.000000;0.250000;0.500000;")
    assert reports.CategoricalBalanceReport(report).render().splitlines()[1] == "sex,m" + ",1.0000,1.0000,0.0000" * 2 + ",0.0000,0.0000"
    reports.write_summary_csv(outcome, tmp_path / "s.csv")
    assert (tmp_path / "s.csv").read_text().splitlines() == [
        "metric,value", "total_anchors_evaluated,2", "matched_anchors,2", "unmatched_anchors,0", "pairs_selected,2", "anchors_with_no_candidates,0",
        "anchors_below_required_ratio,0", "used_controls,2", "avg_controls_per_case,1.0000", "requested_estimand,Att", "realized_estimand,Att"]
    reports.write_exclusion_counts_csv(outcome, tmp_path / "e.csv")
    assert (tmp_path / "e.csv").read_text() == "reason,count\nused_control_replacement_disabled,1\n"
    none = job.with_replacement().run()
    assert reports.ExclusionCountsReport(none).render() == "reason,count\nnone,0\n"
    for write, name in ((reports.write_numeric_csv, "n"), (reports.write_categorical_csv, "c")):
        write(report, tmp_path / name)
        assert len((tmp_path / name).read_text().splitlines()) == 2
    with pytest.raises(TypeError):
        job.with_ratio(2)
    with pytest.raises(TypeError):
        job.with_age_limit(6)


def test_projected_balance_counts_people_once(spark):
    people = spark.createDataFrame([("a", 1.0, "f"), ("b", 3.0, "m"), ("c", 2.0, "f"), ("d", 6.0, None)], "id string, age double, sex string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = projected_balance(people, people.where("id in ('a', 'b')"), ids("a", "b"), ids("c", "c"), "id", {"age": F.col("age")}, {"sex": F.coalesce("sex", F.lit("?"))})
    rows = {r.covariate: r for r in got.collect()}
    assert rows["age"].smd_before == pytest.approx((2 - 4) / ((2 + 8) / 2) ** 0.5)
    assert rows["age"].smd_after == pytest.approx((2 - 2) / 1)
    assert (rows["sex"].metric_type, rows["sex"].smd_before, rows["sex"].smd_after) == ("categorical_max_abs_diff", 0.5, 0.5)


def test_strata_diagnostics(spark):
    rows = lambda *x: spark.createDataFrame(x, "id string, m string")
    pairs = spark.createDataFrame([("a", "c"), ("zz", "c"), ("zz", "d")], PAIRS)
    got = balance_diagnostics(rows(("a", "0101")), rows(("c", "0101"), ("d", None)), pairs, {"m": "m"})
    assert {r.key: (r.anchor_count, r.candidate_count) for r in got.collect()} == {"anchor:m=0101": (1, 0), "candidate:m=0101": (0, 2)}
    assert (match_rate(1, 2), match_rate(0, 0)) == (0.5, 0.0)


def test_weights(spark):
    pairs = spark.createDataFrame([("a1", "c1"), ("a1", "c2"), ("a2", "c2")], PAIRS)
    got = lambda e: {r.unit_id: r.match_weight for r in w.match_weights(pairs, e).collect()}
    assert got(Estimand.ATE) == {"a1": 2, "a2": 1, "c1": 1, "c2": 2}
    assert got(Estimand.ATT) == {"a1": 1, "a2": 1, "c1": 0.5, "c2": 1.5}
    assert got(Estimand.ATC) == {"a1": 1.5, "a2": 0.5, "c1": 1, "c2": 1}
    units = spark.createDataFrame([("a1", "anchor", 1.0), ("a2", "anchor", 2.0), ("c1", "candidate", 0.5)], "unit_id string, role string, match_weight double")
    table = w.unit_table(units, spark.createDataFrame([("a2", 3.0), ("c1", 4.0)], "id string, w double"))
    assert {r.unit_id: r.analysis_weight for r in table.collect()} == {"a1": 1, "a2": 6, "c1": 2}
    totals = {r.role: (r.total, r.ess) for r in w.weight_totals(table).collect()}
    assert totals["anchor"] == pytest.approx((7, 49 / 37))


@pytest.mark.parametrize(("a", "c", "k", "estimand", "reference", "want"), [
    ((0.1, 0.3), (0.2, 0.4), 2, Estimand.ATT, "pooled", [1, 1, 1, 1]),
    ((0.1, 0.2), (0.8, 0.9), 2, Estimand.ATT, "pooled", []),
    ((0.10, 0.11, 0.90), (0.12, 0.92), 2, Estimand.ATE, None, [1.5, 1.5, 2, 3, 2]),
    ((0.5,), (0.6, 0.7), 6, Estimand.ATT, None, [1, 0.5, 0.5]),
])
def test_subclasses(spark, a, c, k, estimand, reference, want):
    rows = [(f"a{i}", "anchor", x) for i, x in enumerate(a)] + [(f"c{i}", "candidate", x) for i, x in enumerate(c)] + [("n", "candidate", float("nan"))]
    got = w.subclassify(spark.createDataFrame(rows, "unit_id string, role string, score double"), estimand, k, reference)
    assert [r.weight for r in got.units.orderBy("unit_id").collect()] == pytest.approx(want)
    dropped = [(r.unit_id, r.why) for r in got.dropped.orderBy("place", "unit_id").collect()]
    assert dropped[0] == ("n", "no_score")
    assert len(dropped) == len(rows) - len(want)
    assert got.table.count() == (k if len(a) > 1 else 1)
    assert got.realized() == got.units.select("subclass").distinct().count()


def test_reconstruction_in_two_tiers(spark):
    ddl = "ord int, person_id string, index_date date, exposed boolean, sex int, municipality string, region string, family_id string, birth_date date"
    day, born = D(2020, 1, 1), D(2010, 1, 1)
    rows = [
        (0, "case", day, True, 1, "0101", "H", "f1", born),
        (1, "case", day, True, 1, "9999", "H", None, born),  # the same episode again
        (2, "near", day, False, 1, " 0101 ", "H", None, born + dt.timedelta(3)),
        (3, "far", day, False, 1, "9999", "H", None, born),
        (4, "full", day, False, 1, "0101", "H", None, born),
        (5, "other sex", day, False, None, "0101", "H", None, born),
    ]
    got = reconstruct_pairs(spark.createDataFrame(rows, ddl), ReconstructionOptions(2, 31))
    assert {(r.case_id, r.control_id, r.tier, r.days) for r in got.pairs.collect()} == {("case", "near", "municipality", 3), ("case", "far", "region_fallback", 0)}
    assert {(r.kind, r.id) for r in got.ids().collect()} >= {("eligible_case", "case"), ("municipality_control", "near"), ("region_control", "far"), ("matched_case", "case")}


def test_reconstruction_equals_a_serial_loop(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = []
    for i in range(120):
        m = pick("m1", "m2", "m3", "m4", None, " ")
        born = pick(None, D(2010, 1, 1) + dt.timedelta(rng.randrange(60)))
        rows.append((i, f"p{rng.randrange(70)}", D(2020, 1, rng.randrange(1, 3)), rng.random() < 0.3, pick(0, 1, None), m, pick("r1", None) if m in ("m1", "m2") else pick("r2", "r3"), pick("f1", "f2", None, None), born))
    cases, seen = [], set()
    for r in rows:
        if r[3] and (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            cases.append(r)
    assigned, want = [0] * len(cases), set()
    clean = lambda x: (x or "").strip() or None
    for c in rows:
        if c[3]:
            continue
        for at, tier in ((5, "municipality"), (6, "region_fallback")):
            found = []
            for k, x in enumerate(cases):
                days = abs((x[8] - c[8]).days) if x[8] and c[8] else None
                if clean(c[at]) and clean(x[at]) == clean(c[at]) and x[2] == c[2] and (x[4] is None) == (c[4] is None) and x[4] == c[4] and assigned[k] < 2 and x[1] != c[1] and not (x[7] and x[7] == c[7]) and (days is None or days <= 20):
                    found.append((assigned[k], 10**9 if days is None else days, x[1], k))
            if found:
                k = min(found)[3]
                assigned[k] += 1
                want.add((cases[k][1], c[1], c[2], tier))
                break
    ddl = "ord int, person_id string, index_date date, exposed boolean, sex int, municipality string, region string, family_id string, birth_date date"
    got = reconstruct_pairs(spark.createDataFrame(rows, ddl), ReconstructionOptions(2, 20))
    assert {(r.case_id, r.control_id, r.index_date, r.tier) for r in got.pairs.collect()} == want
