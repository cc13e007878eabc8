"""Covariate balance before and after matching."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import covariates as cov
from pairwell.functions.running import running_counts
from pairwell.plans.spec import BalanceThresholds, Transform
from pairwell.sources.cohort import finite
from pairwell.sources.staging import written

PHASES = ("pre", "post")
#: Places of the grid of quantiles that one task compares at once.
STRETCH = 500_000
METRICS = ("mean_case", "mean_control", "smd", "variance_ratio", "ecdf_mean", "ecdf_max", "eqq_mean", "eqq_max")


def samples(cases: DataFrame, controls: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """The rows of cases and controls with role and phase; after matching, once per pair they are in."""

    def side(df: DataFrame, role: str) -> DataFrame:
        times = pairs.groupBy(F.col("anchor_id" if role == "case" else "candidate_id").alias("__unit")).agg(F.count(F.lit(1)).alias("__times"))
        post = df.join(times, F.col(id_col).cast("string") == F.col("__unit")).drop("__unit")
        both = df.withColumns({"phase": F.lit("pre"), "times": F.lit(1).cast("long")}).unionByName(post.withColumn("phase", F.lit("post")).withColumnRenamed("__times", "times"))
        return both.withColumn("role", F.lit(role))

    return side(cases, "case").unionByName(side(controls, "control"))


def smd(m1: Column, m0: Column, v1: Column, v0: Column) -> Column:
    pooled = (v1 + v0) / 2
    return F.when(pooled > 0, (m1 - m0) / F.sqrt(pooled)).otherwise(0.0)


def variance_ratio(v1: Column, v0: Column) -> Column:
    return F.when((v0 > 0) & (v1 >= 0) & (v1 < float("inf")), F.try_divide(v1, v0)).otherwise(0.0)


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def ecdf_distances(cum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ecdf_mean, ecdf_max) of cum(keys, x, k_case, k_control, cum_k_case, cum_k_control): distances over the pooled distinct values."""
    n = cum.groupBy(*keys).agg(F.sum("k_case").alias("n_case"), F.sum("k_control").alias("n_control"))
    gap = F.abs(F.try_divide(F.col("cum_k_case"), F.col("n_case")) - F.try_divide(F.col("cum_k_control"), F.col("n_control")))
    return cum.join(F.broadcast(n), [*keys]).groupBy(*keys).agg(_zero(F.avg(gap)).alias("ecdf_mean"), _zero(F.max(gap)).alias("ecdf_max"))  # n: a row per covariate and phase


def eqq_distances(cum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, eqq_mean, eqq_max): distances of quantiles on the grid of the larger side's order statistics.

    The larger side's quantiles on that grid are its sorted values; the smaller side's are interpolated between
    the two values around. A value goes, with its places and how many have it, to the stretches of the grid that it
    bears on; within a stretch it is written out as often as it occurs.
    """
    n = cum.groupBy(*keys).agg(F.sum("k_case").alias("n_case"), F.sum("k_control").alias("n_control"))
    n = F.broadcast(n.where("n_case > 0 and n_control > 0"))  # a row per covariate and phase
    sides = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"k_{r}").alias("k"), (F.col(f"cum_k_{r}") - F.col(f"k_{r}")).alias("at")) for r in ("case", "control")])
    runs = cum.select(*keys, "x", F.explode(sides).alias("s")).where("s.k > 0").select(*keys, "x", "s.*").join(n, [*keys])
    most, fewer = F.greatest("n_case", "n_control"), F.least("n_case", "n_control") - 1
    runs = runs.withColumns({"large": (F.col("role") == "case") == (F.col("n_case") >= F.col("n_control")), "most": most, "fewer": fewer})
    step = F.when(fewer > 0, (most - 1) / fewer)
    first = F.when(F.col("large"), F.col("at")).otherwise(F.coalesce(F.floor((F.col("at") - 1) * step) - 2, F.lit(0)))  # some room for rounding
    last = F.when(F.col("large"), F.col("at") + F.col("k") - 1).otherwise(F.coalesce(F.ceil((F.col("at") + F.col("k")) * step) + 2, most))
    stretch = lambda i: F.floor(F.least(F.greatest(i, F.lit(0)), most - 1) / STRETCH)
    dealt = runs.select(*keys, "x", "k", "at", "large", "most", "fewer", F.explode(F.sequence(stretch(first), stretch(last))).alias("stretch"))
    schema = ", ".join(f"{k} string" for k in keys) + ", total double, n long, most double"
    parts = dealt.groupBy(*keys, "stretch").applyInArrow(lambda t: _stretch(t, list(keys), STRETCH), schema)
    return parts.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("eqq_mean"), F.max("most").alias("eqq_max"))


def _stretch(table: pa.Table, keys: list[str], size: int) -> pa.Table:
    """The sum, number and greatest of the distances on one stretch of the grid."""
    large = table.column("large").to_numpy()
    x, k, at = (table.column(c).to_numpy() for c in ("x", "k", "at"))
    n, fewer, start = table.column("most")[0].as_py(), table.column("fewer")[0].as_py(), table.column("stretch")[0].as_py() * size
    end, last = min(start + size, n), max(n, 2) - 1

    def written_out(which: np.ndarray, low: int, high: int) -> np.ndarray:
        """The values at places low to high - 1 of a side."""
        order = np.argsort(at[which])
        places = at[which][order]
        return np.repeat(x[which][order], np.maximum(np.minimum(places + k[which][order], high) - np.maximum(places, low), 0))

    whole, over = divmod(start * fewer, last)  # beyond 64 bits for very large samples
    more = over + np.arange(end - start) * fewer
    lower, rest = whole + more // last, more % last
    few = written_out(~large, int(lower[0]), min(int(lower[-1]) + 1, fewer) + 1)
    low, high = few[lower - lower[0]], few[np.minimum(lower + 1, fewer) - lower[0]]
    gap = np.abs(written_out(large, start, end) - np.where(rest == 0, low, low + rest / last * (high - low)))
    return pa.table([*[table.column(c).slice(0, 1) for c in keys], [float(gap.sum())], [len(gap)], [float(gap.max())]], names=[*keys, "total", "n", "most"])


def numeric_balance(sampled: DataFrame, features: Sequence[str] | Mapping[str, Column], eqq: bool = True) -> DataFrame:
    """Per covariate and phase: counts, means, population variances, SMD, variance ratio, eCDF and eQQ distances.

    features: columns, or names and expressions. Missing and non-finite values are left out; empty samples have
    mean and variance zero, and distances from them are zero. All features are one pass over the sample: it is
    counted by value, and everything else works on these counts.
    """
    exprs = features if isinstance(features, Mapping) else {c: F.col(c).cast("double") for c in features}
    if not exprs:
        raise ValueError("no features")
    times = F.col("times") if "times" in sampled.columns else F.lit(1)
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("covariate"), finite(x).alias("x")) for name, x in exprs.items()]))
    long = sampled.select("role", "phase", times.alias("times"), cells.alias("cell")).select("role", "phase", "times", "cell.*").where("x is not null")
    keys = ["covariate", "phase"]
    count = lambda role: F.sum(F.when(F.col("role") == role, F.col("times")).otherwise(0))
    counted = written(long.groupBy(*keys, "x").agg(count("case").alias("k_case"), count("control").alias("k_control")), "counted")
    spine = sampled.sparkSession.createDataFrame([(c, p, i) for i, c in enumerate(exprs) for p in PHASES], "covariate string, phase string, place int")
    n = lambda r: F.sum(f"k_{r}")
    mean = lambda r: _zero(F.try_divide(F.sum(F.col(f"k_{r}") * F.col("x")), n(r)))
    means = counted.groupBy(*keys).agg(n("case").alias("n_case"), n("control").alias("n_control"), mean("case").alias("mean_case"), mean("control").alias("mean_control"))
    means = F.broadcast(means)  # two rows per covariate, as all that follows
    var = lambda r: _zero(F.try_divide(F.sum(F.col(f"k_{r}") * F.pow(F.col("x") - F.col(f"mean_{r}"), F.lit(2.0))), n(r)))
    spread = counted.join(means, keys).groupBy(*keys).agg(var("case").alias("var_case"), var("control").alias("var_control"))
    cum = written(running_counts(counted, keys, "x", {c: F.col(c) for c in ("k_case", "k_control")}), "running")
    parts = [means, spread, ecdf_distances(cum, keys)] + ([eqq_distances(cum, keys)] if eqq else [])
    out = spine
    for p in parts:
        out = out.join(F.broadcast(p), keys, "left")
    numbers = [c for c in out.columns if c not in (*keys, "place", "n_case", "n_control")]
    out = out.withColumns({c: _zero(F.col(c)) for c in numbers} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_case", "n_control")})
    none = (F.col("n_case") == 0) | (F.col("n_control") == 0)
    out = out.withColumns({c: F.when(none, 0.0).otherwise(F.col(c)) for c in ("ecdf_mean", "ecdf_max")})
    v1, v0 = F.col("var_case"), F.col("var_control")
    return out.withColumns({"smd": smd(F.col("mean_case"), F.col("mean_control"), v1, v0), "variance_ratio": variance_ratio(v1, v0)})


def wide(report: DataFrame) -> DataFrame:
    """A row per covariate, in their order, with each metric before and after."""
    named = [F.max(F.when(F.col("phase") == p, F.col(m))).alias(f"{m}_{p}") for p in PHASES for m in METRICS]
    return report.groupBy("place", "covariate").agg(*named).orderBy("place").drop("place")


def categorical_balance(sampled: DataFrame, levels: Mapping[str, Column], listed: Mapping[str, Column] | None = None) -> DataFrame:
    """Per covariate and level: proportions and their SMD before and after, and Cramer's V of the covariate.

    levels: names and level expressions; null is the level missing. listed: whether a row before matching may
    add its level to those reported (all do if not given). Rows of other levels count as rows, but not as a
    level. A covariate without any listed level reports missing.
    """
    listed = listed or {}
    times = F.col("times") if "times" in sampled.columns else F.lit(1).cast("long")
    cell = [F.struct(F.lit(k).alias("covariate"), F.coalesce(x.cast("string"), F.lit(cov.MISSING)).alias("level"), listed.get(k, F.lit(True)).alias("lists")) for k, x in levels.items()]
    long = sampled.select("role", "phase", times.alias("times"), F.explode(F.array(*cell)).alias("cell")).select("role", "phase", "times", "cell.*")
    at = lambda role, phase: F.sum(F.when((F.col("role") == role) & (F.col("phase") == phase), F.col("times")).otherwise(0))
    sides = [(r, p) for p in PHASES for r in ("case", "control")]
    counted = written(long.groupBy("covariate", "level").agg(*[at(r, p).alias(f"n_{r}_{p}") for r, p in sides], F.max(F.col("lists") & (F.col("phase") == "pre")).alias("lists")), "levels")
    rows = F.broadcast(counted.groupBy("covariate").agg(*[F.sum(f"n_{r}_{p}").alias(f"t_{r}_{p}") for r, p in sides], F.max("lists").alias("any")))  # a row per covariate
    out = counted.join(rows, "covariate").where(F.col("lists") | (~F.col("any") & (F.col("level") == cov.MISSING)))
    p = {(r, ph): _zero(F.try_divide(F.col(f"n_{r}_{ph}"), F.col(f"t_{r}_{ph}"))) for r, ph in sides}
    out = out.withColumns({f"p_{r}_{ph}": x for (r, ph), x in p.items()})
    for ph in PHASES:
        p1, p0 = F.col(f"p_case_{ph}"), F.col(f"p_control_{ph}")
        out = out.withColumn(f"smd_{ph}", smd(p1, p0, p1 * (1 - p1), p0 * (1 - p0)))
    listed_only = out.groupBy("covariate").agg(*[F.sum(f"n_{r}_{ph}").alias(f"s_{r}_{ph}") for r, ph in sides])
    v = out.join(F.broadcast(listed_only), "covariate")  # a row per covariate

    def part(r: str, ph: str) -> Column:
        both, n = F.col(f"n_case_{ph}") + F.col(f"n_control_{ph}"), F.col(f"s_case_{ph}") + F.col(f"s_control_{ph}")
        expected = F.try_divide(both.cast("double") * F.col(f"s_{r}_{ph}"), n)
        return F.when(both > 0, F.pow(F.col(f"n_{r}_{ph}") - expected, F.lit(2.0)) / F.greatest(expected, F.lit(1e-12))).otherwise(0.0)

    def cramers_v(ph: str) -> Column:
        n = F.max(F.col(f"s_case_{ph}") + F.col(f"s_control_{ph}"))
        return _zero(F.sqrt(F.try_divide(F.sum(part("case", ph) + part("control", ph)), n))).alias(f"cramers_v_{ph}")

    v = v.groupBy("covariate").agg(*[cramers_v(ph) for ph in PHASES])
    order = [f"{m}_{ph}" for ph in PHASES for m in ("n_case", "n_control", "p_case", "p_control", "smd")]
    out = out.join(F.broadcast(v), "covariate").select("covariate", "level", *order, "cramers_v_pre", "cramers_v_post")
    return out.orderBy("covariate", "level")


def threshold_summary(report: DataFrame, limits: BalanceThresholds = BalanceThresholds()) -> DataFrame:
    """The matched rows of numeric_balance with a check per limit (null where it is off), passed, and all_passed of all rows."""

    def check(x: str, low: float | None, high: float | None) -> Column:
        tests = [F.col(x) >= low] if low is not None else []
        tests += [F.col(x) <= high] if high is not None else []
        if not tests:
            return F.lit(None).cast("boolean")
        return tests[0] & tests[-1]

    size = F.abs("smd").alias("__size")
    checks = {
        "smd_ok": check("__size", None, limits.smd),
        "ratio_ok": check("variance_ratio", limits.var_ratio_min, limits.var_ratio_max),
        "ecdf_ok": check("ecdf_max", None, limits.ecdf_max),
        "eqq_ok": check("eqq_max", None, limits.eqq_max) if "eqq_max" in report.columns else F.lit(None).cast("boolean"),
    }
    out = report.where("phase = 'post'").select("*", size).withColumns(checks).drop("__size")
    passed = F.lit(True)
    for c in checks:
        passed = passed & F.coalesce(F.col(c), F.lit(True))
    out = out.withColumn("passed", passed)
    return out.crossJoin(F.broadcast(out.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))))  # one row


@dataclass(frozen=True)
class BalanceOptions:
    """Transformed numbers to report too, and covariates of side tables (id, covariates) for keys that records lack."""

    transform: Transform = Transform.NONE
    cases_more: DataFrame | None = None
    controls_more: DataFrame | None = None


@dataclass(frozen=True)
class BalanceReport:
    """numeric: numeric_balance of all numeric features, by phase; categorical: categorical_balance of the others.

    Either is computed when it is first asked for.
    """

    numbers: Callable[[], DataFrame | None]
    levels: Callable[[], DataFrame | None]

    @cached_property
    def numeric(self) -> DataFrame | None:
        return self.numbers()

    @cached_property
    def categorical(self) -> DataFrame | None:
        return self.levels()

    def wide(self) -> DataFrame | None:
        return wide(self.numeric) if self.numeric is not None else None

    def thresholds(self, limits: BalanceThresholds = BalanceThresholds()) -> DataFrame:
        return threshold_summary(self.numeric, limits)


def numeric_features(keys: Sequence[str], transform: Transform, column: str = "covariates") -> dict[str, Column]:
    """Names and values: the keys, then their squares, then products of pairs of keys."""
    out = {k: cov.number(column, k) for k in keys}
    if transform is not Transform.NONE:
        out |= {f"{k}^2": F.pow(cov.number(column, k), F.lit(2.0)) for k in keys}
    if transform is Transform.SQUARES_AND_INTERACTIONS:
        out |= {f"{a} * {b}": cov.number(column, a) * cov.number(column, b) for a, b in combinations(keys, 2)}
    return out


def balance_report(cases: DataFrame, controls: DataFrame, pairs: DataFrame, options: BalanceOptions = BalanceOptions(), id_col: str = "id", column: str = "covariates", order: str | None = None) -> BalanceReport:
    """Balance of every covariate in the map column, whose kind is that of the first record that has it (cases first)."""
    cases = cov.with_supplemental(cases, id_col, column, options.cases_more)
    controls = cov.with_supplemental(controls, id_col, column, options.controls_more)
    first = order or id_col
    side = lambda df, k: df.select(F.lit(k).alias("side"), F.col(first).alias("ord"), F.col(id_col).alias("id"), F.col(column).alias("covariates"))
    both = side(cases, 0).unionByName(side(controls, 1))
    numeric, other = cov.keys_by_kind(both, "covariates", ["side", "ord", "id"])
    for m in (options.cases_more, options.controls_more):  # keys that no record shows are categorical
        if m is not None:
            known = {r[0] for r in m.select(F.explode(F.map_keys(m.columns[1]))).distinct().collect()}
            other = sorted({*other, *known} - set(numeric))
    slim = lambda df: df.select(F.col(id_col).alias("id"), F.col(column).alias("covariates"))
    sampled = samples(slim(cases), slim(controls), pairs, "id")
    return BalanceReport(
        lambda: numeric_balance(sampled, numeric_features(numeric, options.transform)) if numeric else None,
        lambda: categorical_balance(sampled, {k: cov.level("covariates", k) for k in other}, {k: cov.present("covariates", k) for k in other}) if other else None,
    )


def balance_diagnostics(cases: DataFrame, controls: DataFrame, pairs: DataFrame, strata: Mapping[str, str], id_col: str = "id") -> DataFrame:
    """(key, anchor_count, candidate_count): pairs by the strata of either side, as anchor:key=value and candidate:key=value.

    Ids that are not among the records are left out, and so are missing strata. The match rate and the other
    counts of the run are in its diagnostics.
    """

    def side(df: DataFrame, id_of: str, role: str) -> DataFrame:
        ids = pairs.select(F.col(id_of).alias("__unit"))
        rows = df.join(ids, F.col(id_col).cast("string") == F.col("__unit"))
        cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{role}:{k}="), F.col(c).cast("string"))) for k, c in strata.items()]
        return rows.select(F.explode(F.array(*cells)).alias("key"), F.lit(role).alias("role")).where("key is not null")

    both = side(cases, "anchor_id", "anchor").unionByName(side(controls, "candidate_id", "candidate"))
    return both.groupBy("key").agg(F.count_if(F.col("role") == "anchor").alias("anchor_count"), F.count_if(F.col("role") == "candidate").alias("candidate_count"))


def match_rate(matched: int, cases: int) -> float:
    return matched / cases if cases else 0.0
