"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's repetition rate. The draw
inverts the distribution at a uniform that is a hash of (seed, id), so it is the same on every run, on any
partitioning, and after a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import staged, table

#: Hex digits of the hash that make the uniform: 52 bits, exact in a double.
DIGITS = 13


def hash_unit(*parts: Column) -> Column:
    """A uniform in [0, 1) from md5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """First k and P(X <= k), P(X <= k + 1), ... for all k whose tails exceed what 52 bits can tell."""
    if not rate > 0:
        return 0, [1.0]
    spread = 9 * math.sqrt(rate) + 40
    low, high = max(0, int(rate - spread)), int(rate + spread) + 1
    total, out = 0.0, []
    for k in range(low, high + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
    return low, out


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, size: float, source_col: str) -> DataFrame:
    """(src, rate) for every source: target share * size * all documents / the source's documents."""
    counts = staged(docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        counts = counts.join(given, F.col("src").eqNullSafe(F.col("name")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    n, total = counts.agg(F.sum("n"), F.sum("weight")).first()
    return counts.select("src", (F.col("weight") * float(size) * (n or 0) / (total or 1.0) / F.col("n")).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """docs with each row repeated, in a global random order, plus copy (long, from 1) and order_key (double).

    weights gives a target weight by source (absent sources get none); without it, a source's weight is its
    number of documents to the power temperature. size is the expected output over the input, in rows. Rows
    are dealt to partitions by order_key and sorted by it within each.

    A null source is a source of its own; a null id hashes as the row's source and text; rows with the same id
    draw the same count. Text is looked at only where the id is null. Columns named copy or order_key are replaced. Empty in, empty out.
    """

    def tables(batches: Iterator) -> Iterator:
        for b in batches:
            cdfs = [poisson_cdf(x) for x in b["rate"]]
            yield b.assign(low=[x[0] for x in cdfs], cdf=[x[1] for x in cdfs])[["src", "low", "cdf"]]

    kind = dict(docs.dtypes)[source_col]
    cdf = source_rates(docs, weights, temperature, size, source_col).mapInPandas(tables, f"src {kind}, low long, cdf array<double>")
    cdf = staged(cdf.select(F.col("src").alias("__src"), F.col("low").alias("__low"), F.col("cdf").alias("__cdf")), "cdf")
    unnamed = F.concat_ws(":", F.lit("text"), *[F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (source_col, text_col)])
    ident = F.coalesce(F.col(id_col).cast("string"), unnamed)
    unit = hash_unit(F.lit(f"draw{seed}"), ident)
    joined = docs.join(cdf, F.col(source_col).eqNullSafe(F.col("__src"))).withColumn("__u", unit)
    times = F.col("__low") + F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    many = joined.withColumn("__n", times).drop("__src", "__low", "__cdf", "__u").where("__n > 0")
    out = many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    out = out.withColumn("copy", F.col("copy").cast("long")).withColumn("order_key", hash_unit(F.lit(f"order{seed}"), ident, F.col("copy").cast("string")))
    return out.repartition(F.col("order_key")).sortWithinPartitions("order_key")


def query(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = """
WITH sources AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(n::DOUBLE, 0.5) * 1.0 * (SELECT sum(n) FROM sources)
         / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM sources) / n AS rate FROM sources),
pmf AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, range(0, 200) t(k)),
cdf AS (SELECT source, k, least(1.0, sum(p) OVER (PARTITION BY source ORDER BY k)) AS c FROM pmf),
units AS (SELECT *, ('0x' || substr(md5('draw7:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
times AS (SELECT doc_id, count(*) AS times FROM units d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY doc_id),
draws AS (SELECT * FROM documents JOIN times USING (doc_id)),
copies AS (SELECT *, unnest(range(1, times + 1)) AS copy FROM draws)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy,
       ('0x' || substr(md5('order7:' || doc_id::VARCHAR || ':' || copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS order_key
FROM copies
"""
