"""Token counts as an exact histogram of encoded lengths.

Documents are encoded whole and counted by length. Suffix sums over the lengths then answer, for every context
limit, how many documents reach it, how many tokens those hold, and what remains after truncation. They are
taken in two steps, within blocks of lengths and over the blocks' totals, so that no task needs all lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.llm.common import staged, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024
#: Longest run of text that is given to the encoder at once, in characters.
CHUNK = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def safe_cuts(text: str) -> Iterator[str]:
    """Parts of a long text, cut before a space between letters, where the pattern always starts a new piece."""
    start = 0
    while len(text) - start > CHUNK:
        at = text.find(" ", start + CHUNK)
        while at > 0 and not (text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """docs without text_col, plus n_tokens (long): the whole text's length; null or empty text has none."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))  # one vocabulary file, of fixed size
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        count = lambda text: sum(len(encoder.encode_ordinary(x)) for x in safe_cuts(text)) if text else 0
        for b in batches:
            n = pa.array([count(x.as_py()) for x in b.column(text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [n], [*rest, "n_tokens"])

    return docs.select(*rest, text_col).mapInArrow(run, docs.select(*rest).schema.add("n_tokens", "long"))


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs), exact: each task counts its own rows, then counts are summed by length."""
    lengths = encoded_lengths(docs.select(F.col(text_col).alias("text")), vocabulary)
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist(n_tokens, n_docs) with, for each length taken as a context limit:

    docs_ge, tokens_ge: documents of at least that length, and their tokens; docs_le: of at most that length;
    truncated_total: tokens left if longer documents are cut at the limit; share_le: docs_le over all (the
    quantile that this length answers). Empty in, empty out.
    """
    hist = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("t"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = staged(hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt")), "blocks")
    totals = blocks.agg(F.sum("bd"), F.sum("bt")).first()
    docs, tokens = (int(x or 0) for x in totals)
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = blocks.select("block", F.coalesce(F.sum("bd").over(down), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(down), F.lit(0)).alias("at"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(above, "block").withColumns({"docs_ge": F.sum("n_docs").over(within) + F.col("ad"), "tokens_ge": F.sum("t").over(within) + F.col("at")})
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (docs - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (tokens - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        ((docs - F.col("docs_ge") + F.col("n_docs")) / F.lit(float(docs or 1))).alias("share_le"),
    )


class LengthAnswers:
    """Answers from a table of suffix sums, each by a small aggregate over it."""

    def __init__(self, sums: DataFrame) -> None:
        self.sums = sums

    def total(self) -> int:
        return int(self.sums.agg(F.max("tokens_ge")).first()[0] or 0)

    def truncated_total(self, limits: Sequence[int]) -> dict[int, int]:
        """Tokens left for each context limit."""
        total = self.total()
        out = {}
        for limit in limits:  # the least length over the limit holds the sums of all documents to cut
            row = self.sums.where(F.col("n_tokens") > limit).agg(F.max("docs_ge"), F.max("tokens_ge")).first()
            out[limit] = total - int(row[1] or 0) + limit * int(row[0] or 0)
        return out

    def quantile(self, shares: Sequence[float]) -> dict[float, int | None]:
        """The least length that at least the given share of documents do not exceed."""
        return {s: self.sums.where(F.col("share_le") >= s).agg(F.min("n_tokens")).first()[0] for s in shares}


def length_sums(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """The histogram of docs with its suffix sums (see suffix_sums); null and empty texts count as length 0."""
    return suffix_sums(staged(histogram(docs, vocabulary, text_col), "histogram"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_sums(table(spark, sf_dir, "documents"))


