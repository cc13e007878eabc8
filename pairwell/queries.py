"""The registered queries of the cohort operators.

The main cohort is the orders table: anchors have status P, candidates status O, and the priority is the stratum.
The longitudinal cohort is the customer table: birth, death and the end of residence are made from the key, and
the event is a customer's first urgent order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions.covariates import covariates
from pairwell.functions.distance import DistanceConfig
from pairwell.job import MatchJob
from pairwell.operators.balance import BalanceOptions, BalanceReport, balance_diagnostics, balance_report
from pairwell.operators.candidates import eligible
from pairwell.operators.constraints import caliper, date_window, gender_match
from pairwell.operators.design import design_matrix, ranked
from pairwell.operators.estimation import estimate_propensity_and_match, prepare_mahalanobis, prepare_propensity
from pairwell.operators.matching import Outcome, match_standard, nearest_birth_date, random_order
from pairwell.operators.projected import projected_balance
from pairwell.operators.reconstruction import ReconstructionOptions, reconstruct_pairs
from pairwell.operators.transition import match_transition
from pairwell.operators.weights import Subclasses, match_weights, pair_weights, subclassify, unit_table, weight_totals
from pairwell.oracle import ORACLE_SQL
from pairwell.plans.estimation import CovarianceOf, ElasticNet, Encoding, MahalanobisConfig, PropensityConfig
from pairwell.plans.spec import BirthWindowDays, CommonSupport, DistanceCaliper, Estimand, MatchingCriteria, MatchRatio, Transform
from pairwell.sources import reports
from pairwell.sources.cohort import CohortSchema

SCHEMA = CohortSchema(id="o_orderkey", birth_date="o_orderdate", strata={"priority": "o_orderpriority"}, unique_key="o_custkey")
BASE = MatchingCriteria(birth_window_days=30, ratio=2, required_strata=("priority",))
MEMBERS = CohortSchema(id="c_custkey", birth_date="birth", strata={"segment": "c_mktsegment"}, unique_key="family", death_date="death", event_date="event")


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return rows.where("o_orderstatus = 'P'"), rows.where("o_orderstatus = 'O'")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("event"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    after = lambda day, factor, span: F.date_add(F.lit(day).cast("date"), (F.col("c_custkey") * factor % span).cast("int"))
    return rows.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").withColumns({
        "birth": after("1990-01-01", 37, 2000),
        "death": F.when(F.col("c_custkey") % 5 == 0, after("1996-01-01", 53, 1500)),
        "resident_until": F.when(F.col("c_custkey") % 4 == 0, after("1997-01-01", 11, 1200)),
        "family": F.floor(F.col("c_custkey") / 3),
    })


def outcome(spark: SparkSession, sf_dir: str, **kw) -> Outcome:
    criteria = BASE.with_(**{k: kw.pop(k) for k in ("allow_replacement", "unique_by_key", "ratio") if k in kw})
    return match_standard(*orders(spark, sf_dir), SCHEMA, criteria, **kw)


def reused(spark: SparkSession, sf_dir: str) -> Outcome:
    return outcome(spark, sf_dir, allow_replacement=True)


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("anchor_id", "candidate_id", F.col("days").cast("long").alias("days"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def edges(spark, sf_dir):
    out = eligible(reused(spark, sf_dir).edges)
    return out.select(F.col("a_id").alias("anchor_id"), F.col("c_id").alias("candidate_id"), F.col("days").cast("long").alias("days"))


def nearest(spark, sf_dir):
    return _pairs(outcome(spark, sf_dir).pairs)


def unique_customers(spark, sf_dir):
    return _pairs(outcome(spark, sf_dir, unique_by_key="customer").pairs)


def seeded_random(spark, sf_dir):
    return _pairs(outcome(spark, sf_dir, strategy=random_order(11)).pairs)


def fallback(spark, sf_dir):
    return _pairs(outcome(spark, sf_dir, fallback=(MatchRatio(3), MatchRatio(1))).pairs)


def replacement(spark, sf_dir):
    return _pairs(reused(spark, sf_dir).pairs)


def _summary(o: Outcome) -> DataFrame:
    names = ["total_anchors_evaluated", "anchors_with_no_candidates", "anchors_below_required_ratio", "matched_anchors", "unmatched_anchors", "pairs_selected", "used_controls", "avg_controls_per_case", "requested_estimand", "realized_estimand", "drift_reasons"]
    return _rounded(o.summary().select(*names))


def diagnostics(spark, sf_dir):
    return _summary(outcome(spark, sf_dir, unique_by_key="customer"))


def replacement_summary(spark, sf_dir):
    return _summary(reused(spark, sf_dir))


def exclusions(spark, sf_dir):
    return outcome(spark, sf_dir, unique_by_key="customer").exclusions().select("category", "reason", "n")


def constrained(spark, sf_dir):
    """Equal parity, prices within 50,000, and a second date within a year, as constraints of their own."""
    a, c = (x.withColumns({"parity": F.when(F.col("o_custkey") % 10 > 0, F.col("o_orderkey") % 2), "paid": F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 700).cast("int"))}) for x in orders(spark, sf_dir))
    return match_standard(a, c, SCHEMA, BASE.with_(allow_replacement=True), constraints=[gender_match("parity"), caliper("o_totalprice", 50_000.0), date_window("paid", 365)])


def constraints(spark, sf_dir):
    return constrained(spark, sf_dir).exclusions().select("category", "reason", "n")


def constraint_pairs(spark, sf_dir):
    return _pairs(constrained(spark, sf_dir).pairs)


def _scored(spark, sf_dir, **kw) -> Outcome:
    a, c = orders(spark, sf_dir)
    scores = a.unionByName(c).select("o_orderkey", F.col("o_totalprice").cast("double"))
    return match_standard(a, c, SCHEMA, BASE.with_(**kw), config=DistanceConfig.propensity(scores, DistanceCaliper(500.0)))


def score_caliper(spark, sf_dir):
    return _pairs(_scored(spark, sf_dir).pairs)


def score_exclusions(spark, sf_dir):
    return _scored(spark, sf_dir, unique_by_key="customer").exclusions().select("category", "reason", "n")


def weights(spark, sf_dir):
    return _rounded(match_weights(reused(spark, sf_dir).pairs))


def weights_atc(spark, sf_dir):
    return _rounded(reused(spark, sf_dir).match_weights(Estimand.ATC))


def weights_realized(spark, sf_dir):
    """The nearest match falls short of its ratio, so its realized estimand weighs every pair by one."""
    return _rounded(outcome(spark, sf_dir).match_weights())


def sampling_weights(spark, sf_dir):
    sampling = orders(spark, sf_dir)[0].where("o_custkey % 2 = 0").select(F.col("o_orderkey").cast("string"), (1 + F.col("o_custkey") % 3).cast("double"))
    return _rounded(reused(spark, sf_dir).unit_weight_table(Estimand.ATT, sampling))


def weights_by_pair(spark, sf_dir):
    return _rounded(pair_weights(reused(spark, sf_dir).pairs).select("anchor_id", "candidate_id", "weight"))


def ess(spark, sf_dir):
    return _rounded(weight_totals(unit_table(match_weights(reused(spark, sf_dir).pairs))))


def _report(spark, sf_dir, **kw) -> BalanceReport:
    def side(df: DataFrame) -> DataFrame:
        cells = df.withColumns({"price": F.col("o_totalprice") / 100_000, "customer": F.col("o_custkey") / 1000, "priority": F.nullif("o_orderpriority", F.lit("5-LOW"))})
        return cells.withColumn("covariates", covariates(["price", "customer"], ["priority"]))

    a, c = map(side, orders(spark, sf_dir))
    return balance_report(a, c, reused(spark, sf_dir).pairs, BalanceOptions(**kw), "o_orderkey")


def balance_numeric(spark, sf_dir):
    return _rounded(_report(spark, sf_dir, transform=Transform.SQUARES_AND_INTERACTIONS).wide())


def balance_categorical(spark, sf_dir):
    return _rounded(_report(spark, sf_dir).categorical)


def balance_supplemental(spark, sf_dir):
    """The customer's segment comes from a side table of the anchors, and of every second candidate."""
    segments = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    more = lambda df: df.join(segments, F.col("o_custkey") == F.col("c_custkey")).withColumn("covariates", covariates([], ["c_mktsegment"])).select("o_orderkey", "covariates")
    a, c = orders(spark, sf_dir)
    report = _report(spark, sf_dir, cases_more=more(a), controls_more=more(c.where("o_orderkey % 2 = 0")))
    return _rounded(report.categorical.where("covariate = 'c_mktsegment'").drop("covariate"))


def balance_thresholds(spark, sf_dir):
    return _report(spark, sf_dir).thresholds().select("covariate", "smd_ok", "ratio_ok", "ecdf_ok", "passed", "all_passed")


def balance_projected(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pairs = reused(spark, sf_dir).pairs
    got = projected_balance(people, people.where("o_orderstatus = 'P'"), pairs.select("anchor_id"), pairs.select("candidate_id"), "o_orderkey", {"price": F.col("o_totalprice") / 100_000, "customer": F.col("o_custkey") / 1000}, {"priority": F.col("o_orderpriority")})
    return _rounded(got.drop("place"))


def strata_diagnostics(spark, sf_dir):
    return balance_diagnostics(*orders(spark, sf_dir), reused(spark, sf_dir).pairs, {"priority": "o_orderpriority", "customer": "o_custkey"}, "o_orderkey")


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "place long, line string")


def csv_summary(spark, sf_dir):
    return _lines(spark, reports.MatchSummaryReport(reused(spark, sf_dir)).render())


def csv_exclusions(spark, sf_dir):
    return _lines(spark, reports.ExclusionCountsReport(constrained(spark, sf_dir)).render())


def csv_numeric(spark, sf_dir):
    return _lines(spark, reports.NumericBalanceReport(_report(spark, sf_dir)).render())


def csv_categorical(spark, sf_dir):
    return _lines(spark, reports.CategoricalBalanceReport(_report(spark, sf_dir)).render())


def _subclasses(spark, sf_dir, **kw) -> Subclasses:
    """Every seventeenth unit has no score."""
    unit = lambda df, role: df.select(F.col("o_orderkey").alias("unit_id"), F.lit(role).alias("role"), F.when(F.col("o_orderkey") % 17 > 0, F.col("o_totalprice").cast("double")).alias("score"))
    a, c = orders(spark, sf_dir)
    return subclassify(unit(a, "anchor").unionAll(unit(c, "candidate")), **kw)


def _units(s: Subclasses) -> DataFrame:
    return _rounded(s.units.select("unit_id", "role", F.col("subclass").cast("long").alias("subclass"), "weight"))


def subclasses(spark, sf_dir):
    return _units(_subclasses(spark, sf_dir))


def subclasses_ate(spark, sf_dir):
    return _units(_subclasses(spark, sf_dir, estimand=Estimand.ATE, subclasses=10))


def subclass_summary(spark, sf_dir):
    return _rounded(_subclasses(spark, sf_dir).table)


def subclass_dropped(spark, sf_dir):
    return _subclasses(spark, sf_dir).dropped.select("unit_id", "role", "why", F.col("place").cast("long").alias("place"))


def _transition_job(spark, sf_dir) -> MatchJob:
    job = MatchJob.transition(members(spark, sf_dir), MEMBERS, 3).with_strategy(nearest_birth_date).with_exact_match("segment")
    return job.with_ratio(MatchRatio(2)).with_birth_window(BirthWindowDays(200)).with_alive_check().with_resident_check()


def transition(spark, sf_dir):
    return _pairs(_transition_job(spark, sf_dir).run().pairs)


def transition_exclusions(spark, sf_dir):
    return _transition_job(spark, sf_dir).run().exclusions().select("category", "reason", "n")


def transition_families(spark, sf_dir):
    """Members of a family are used up together, in the whole cohort."""
    return _pairs(_transition_job(spark, sf_dir).with_unique_by_key("family").run().pairs)


def _supported(spark, sf_dir) -> Outcome:
    rows = members(spark, sf_dir)
    scores = rows.select("c_custkey", F.when(F.col("c_custkey") % 11 > 0, F.col("c_acctbal").cast("double")))
    criteria = MatchingCriteria(ratio=1, required_strata=("segment",), common_support=CommonSupport.BOTH)
    return match_transition(rows, MEMBERS, criteria, config=DistanceConfig.propensity(scores, DistanceCaliper(300.0)))


def transition_support(spark, sf_dir):
    return _pairs(_supported(spark, sf_dir).pairs)


def transition_diagnostics(spark, sf_dir):
    names = ["total_anchors_evaluated", "matched_anchors", "unmatched_anchors", "anchors_with_no_candidates", "trimmed_anchors", "trimmed_candidates", "support_overlap_low", "support_overlap_high", "candidate_bounds_low", "candidate_bounds_high", "realized_estimand", "drift_reasons"]
    return _rounded(_supported(spark, sf_dir).summary().select(*names))


def reconstruction(spark, sf_dir):
    """Orders as episodes of a month; towns are nations, regions regions. The choice is serial: no SQL, see the tests."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read("orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    episodes = rows.select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("person_id"), F.trunc("o_orderdate", "month").alias("index_date"), (F.col("o_orderstatus") == "P").alias("exposed"),
        (F.col("o_custkey") % 2).alias("sex"), F.col("n_name").alias("municipality"), F.col("r_name").alias("region"), F.floor(F.col("o_custkey") / 3).alias("family_id"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("o_custkey") * 37 % 2000).cast("int")).alias("birth_date"),
    )
    return reconstruct_pairs(episodes, ReconstructionOptions(2, 400)).pairs


def learners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with numeric covariates, and anchors that these tell apart to some degree."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"price": F.col("o_totalprice") / 100_000, "year": (F.year("o_orderdate") - 1998).cast("double")})
    rows = rows.withColumn("covariates", covariates(["price", "year"]))
    treated = ((F.col("o_totalprice") > 200_000) & (F.col("o_orderkey") % 3 > 0)) | ((F.year("o_orderdate") > 1998) & (F.col("o_orderkey") % 7 == 0))
    return rows.where(treated), rows.where(~treated)


def propensity(spark, sf_dir):
    found = prepare_propensity(*learners(spark, sf_dir), id_col="o_orderkey")
    return _rounded(found.scores.select("id", F.col("label").cast("long").alias("label"), "probability", "linear_predictor"))


def elastic_net(spark, sf_dir):
    config = PropensityConfig(estimator=ElasticNet(max_iter=20, strength=0.05))
    found = prepare_propensity(*learners(spark, sf_dir), config, id_col="o_orderkey")
    return _rounded(found.scores.select("id", "probability"))


def propensity_match(spark, sf_dir):
    schema = CohortSchema(id="o_orderkey", birth_date="o_orderdate", strata={"priority": "o_orderpriority"})
    config = PropensityConfig(caliper=DistanceCaliper(0.002))
    got, _ = estimate_propensity_and_match(*learners(spark, sf_dir), schema, MatchingCriteria(ratio=2, allow_replacement=True, required_strata=("priority",)), config=config)
    return _pairs(got.pairs)


def mahalanobis(spark, sf_dir):
    """Covariance and inverse, within groups and over all rows."""
    rows = []
    for over in CovarianceOf:
        found = prepare_mahalanobis(*learners(spark, sf_dir), MahalanobisConfig(covariance=over), id_col="o_orderkey")
        rows += [(over.value, k, c, i) for k, (c, i) in enumerate(zip(found.covariance, found.inverse_covariance, strict=True))]
    return _rounded(spark.createDataFrame(rows, "over string, cell long, covariance double, inverse double"))


def mahalanobis_match(spark, sf_dir):
    a, c = learners(spark, sf_dir)
    found = prepare_mahalanobis(a, c, caliper=DistanceCaliper(0.01), id_col="o_orderkey")
    schema = CohortSchema(id="o_orderkey", birth_date="o_orderdate", strata={"priority": "o_orderpriority"})
    return _pairs(match_standard(a, c, schema, MatchingCriteria(ratio=2, allow_replacement=True, required_strata=("priority",)), config=found.config).pairs)


def rank_transform(spark, sf_dir):
    rows = ranked(design_matrix(*learners(spark, sf_dir), Encoding(), "o_orderkey")).rows
    return rows.select("id", F.get("x", F.lit(0)).alias("price_rank"), F.get("x", F.lit(1)).alias("year_rank"))


QUERIES = {
    "candidate_edges": edges,
    "match_nearest": nearest,
    "match_unique_key": unique_customers,
    "match_random": seeded_random,
    "match_fallback": fallback,
    "match_replacement": replacement,
    "match_constraints": constraint_pairs,
    "match_score_caliper": score_caliper,
    "match_summary": replacement_summary,
    "match_diagnostics": diagnostics,
    "match_exclusions": exclusions,
    "constraint_exclusions": constraints,
    "score_exclusions": score_exclusions,
    "match_weights": weights,
    "match_weights_atc": weights_atc,
    "match_weights_realized": weights_realized,
    "unit_weight_table": sampling_weights,
    "pair_weights": weights_by_pair,
    "effective_sample_size": ess,
    "balance_numeric": balance_numeric,
    "balance_categorical": balance_categorical,
    "balance_supplemental": balance_supplemental,
    "balance_thresholds": balance_thresholds,
    "balance_projected": balance_projected,
    "balance_diagnostics": strata_diagnostics,
    "csv_summary": csv_summary,
    "csv_exclusions": csv_exclusions,
    "csv_numeric": csv_numeric,
    "csv_categorical": csv_categorical,
    "subclassification": subclasses,
    "subclassification_ate": subclasses_ate,
    "subclass_summary": subclass_summary,
    "subclass_dropped": subclass_dropped,
    "transition_matching": transition,
    "transition_exclusions": transition_exclusions,
    "transition_families": transition_families,
    "transition_support": transition_support,
    "transition_diagnostics": transition_diagnostics,
    "reconstruction": reconstruction,
    "propensity_scores": propensity,
    "elastic_net_scores": elastic_net,
    "propensity_match": propensity_match,
    "mahalanobis_preparation": mahalanobis,
    "mahalanobis_match": mahalanobis_match,
    "rank_transform": rank_transform,
}
__all__ = ["ORACLE_SQL", "QUERIES", "nearest"]
