"""Quality rules at the level of the host.

Each document is measured and tested by fixed rules. Failures are summed by host, each host's failure rate is
shrunk towards all hosts' by a beta prior that is fitted to the hosts themselves, and a host whose shrunk rate
lies far outside of that prior, and is over a half, takes its documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import SPACE, staged, table

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Standard deviations of the prior by which a host's shrunk rate must exceed the mean, and the least rate that rejects.
SPREAD = 3.0
LEAST = 0.5


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    pair = a[:-1] * v + a[1:]
    if v < 2_000_000:
        keys = pair[:-1] * v + a[2:]
    else:  # three ids no longer fit in 63 bits
        keys = np.unique(pair, return_inverse=True)[1][:-1] * v + a[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a whole text; null is empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col, plus the measures."""
    rest = [f for f in docs.schema if f.name != text_col and f.name not in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(x.as_py()) for x in b.column(text_col)]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in rest] + columns, [f.name for f in rest] + list(MEASURES))

    names = [f.name for f in rest]
    schema = docs.select(*names).schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    return docs.select(*names, text_col).mapInArrow(run, schema)


def base_failed(min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def host_rules() -> dict[str, Column]:
    """The rules whose failures are summed by host."""
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 3 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def host_verdicts(stats: DataFrame, host_col: str, spread: float = SPREAD, least: float = LEAST) -> DataFrame:
    """(host, n, rejected) for each host.

    For each rule a beta prior is fitted to the hosts by moments: the mean is that of all documents, the
    variance is what the hosts' rates vary by beyond chance. A host is rejected if the posterior mean of any rule
    is over the prior's mean by more than `spread` of its standard deviations, and over `least`. So a host of few
    documents is spared, and where hosts differ by chance alone none goes.
    """
    rules = host_rules()
    sums = [F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules.items()]
    hosts = staged(stats.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    n, f = F.col("n").cast("double"), {k: F.col(f"f_{k}").cast("double") for k in rules}
    totals = hosts.agg(F.sum("n").alias("n"), F.avg(1 / n).alias("inv"), *[F.sum(f[k]).alias(f"f_{k}") for k in rules], *[F.avg(f[k] / n).alias(f"m_{k}") for k in rules], *[F.avg((f[k] / n) ** 2).alias(f"q_{k}") for k in rules]).first()
    bad = F.lit(False)
    for k in rules:
        mean = (totals[f"f_{k}"] or 0) / (totals["n"] or 1)
        chance = mean * (1 - mean)
        extra = (totals[f"q_{k}"] or 0) - (totals[f"m_{k}"] or 0) ** 2 - chance * (totals["inv"] or 0)
        strength = max(chance / extra - 1, 1.0) if extra > 1e-12 else 1e6
        limit = max(mean + spread * (chance / (strength + 1)) ** 0.5, least)
        bad = bad | ((f[k] + mean * strength) / (n + strength) > limit)
    return hosts.select("host", "n", bad.alias("rejected"))


def judge_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs without text_col, plus the measures, base_failed, host_rejected and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: neither
    base_failed nor of a rejected host (see host_verdicts).

    Null text has no words and fails; a null host is a host of its own; each row is judged by itself, also if
    its id occurs again. Texts are measured whole. Columns with the names of the results are replaced. Empty in,
    empty out.
    """
    names = {"base_failed", "host_rejected", "kept"}
    stats = staged(measured(docs.drop(*names), text_col), "measures")
    verdicts = staged(host_verdicts(stats, host_col).where("rejected").select(F.col("host").alias("__host"), F.lit(True).alias("__bad")), "verdicts")
    out = stats.join(verdicts, F.col(host_col).eqNullSafe(F.col("__host")), "left")
    out = out.withColumns({"base_failed": base_failed(), "host_rejected": F.coalesce("__bad", F.lit(False))})
    return out.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected"))).drop("__host", "__bad")


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge_documents keeps, unchanged, with all their columns.

    Measures are taken in two passes, one for the hosts and one for the rows, so that no text is shuffled. Null
    and empty texts go, as they have no words; null hosts and repeated rows are treated as there. Empty in, empty out.
    """
    slim = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    verdicts = host_verdicts(measured(slim), "host")
    bad = staged(verdicts.where("rejected").select(F.col("host").alias("__host")), "verdicts")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(x.as_py()) for x in b.column(text_col)]
            yield b.filter(pa.array([not (r[0] < 50 or 100 * r[4] > 50 * r[0]) for r in rows], pa.bool_()))

    good = docs.mapInArrow(run, schema)
    return good.join(bad, F.col(host_col).eqNullSafe(F.col("__host")), "left_anti")


def query(spark, sf_dir):
    out = judge_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", *MEASURES, "base_failed", "host_rejected", "kept")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT doc_id, line, count(*) AS c
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dups AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines, sum(c)::BIGINT AS n_lines FROM lines GROUP BY doc_id),
win AS (
  SELECT doc_id, p, words[p] AS a, words[p + 1] AS b, words[p + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM base)),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win),
covered AS (SELECT DISTINCT doc_id, p + o AS q FROM twice, range(0, 3) t(o) WHERE k > 1),
reps AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
stats AS (
  SELECT b.doc_id, b.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id)),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         n_symbols > n_words AS sym, 3 * n_dup_lines > n_lines AS dup FROM stats),
rules AS (
  SELECT source, unnest(['base', 'sym', 'dup']) AS rule,
         unnest([base_failed::INT, sym::INT, dup::INT]) AS f FROM judged),
hosts AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(f)::DOUBLE AS f FROM rules GROUP BY source, rule),
moments AS (
  SELECT rule, sum(f) / sum(n) AS m, avg((f / n) * (f / n)) - avg(f / n) * avg(f / n)
         - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * avg(1 / n) AS extra FROM hosts GROUP BY rule),
prior AS (SELECT rule, m, CASE WHEN extra > 1e-12 THEN greatest(m * (1 - m) / extra - 1, 1.0) ELSE 1e6 END AS s FROM moments),
bad AS (
  SELECT h.source, bool_or((f + m * s) / (n + s) > greatest(m + 3 * sqrt(m * (1 - m) / (s + 1)), 0.5)) AS rejected
  FROM hosts h JOIN prior USING (rule) GROUP BY h.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, rejected AS host_rejected,
       NOT (base_failed OR rejected) AS kept
FROM judged j JOIN bad b ON j.source IS NOT DISTINCT FROM b.source
"""
