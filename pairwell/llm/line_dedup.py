"""Line dedup: drop lines that many documents share, keeping them in one document.

Only DataFrame functions. Lines are exploded and normalised, hashed to 128 bits, and counted per distinct
document; lines over the threshold go back to their documents, which are then cut and rejoined in line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import SPACE, ascii_lower, staged

NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def _digest(key: Column) -> list[Column]:
    """128 bits in two halves, so that different lines do not share a key even among trillions."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to the lines that stay, plus n_lines and n_dropped (both long).

    A key (the stripped, lower-cased line) of at least min_chars code points found in at least min_docs
    distinct documents loses all its lines except those of the largest id holding it.

    Null or empty text is one empty line; a null id is one document that sorts before all others. Rows with
    the same id are one document for counting, and each row is cut by itself. Columns named n_lines or
    n_dropped are replaced, all others are passed through. An empty table gives an empty table.
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = (
        docs.select(doc.alias("doc"), F.explode(F.split(body, "\n")).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", *_digest(F.col("key")))
    )
    shared = keyed.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    shared = staged(shared.select("h1", "h2", "keeper"), "lines")
    drops = (
        keyed.join(shared, ["h1", "h2"])
        .where(F.col("doc") != F.col("keeper"))
        .groupBy(F.col("doc").alias("__drop_id"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__drops"))
    )
    lines = F.split(body, "\n")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.char_length(key) < min_chars) | ~F.array_contains(F.col("__drops"), F.struct(*_digest(key)))

    kept = F.when(F.col("__drops").isNull(), lines).otherwise(F.filter(lines, stays))
    out = docs.join(drops, doc == F.col("__drop_id"), "left")
    out = out.withColumn("__kept", kept).withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size("__kept")).cast("long")})
    return out.withColumn(text_col, F.concat_ws("\n", "__kept")).drop("__drop_id", "__drops", "__kept")


def query(spark, sf_dir):
    from pairwell.llm.common import table

    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.pos, d.line, (s.k IS NOT NULL AND d.doc_id <> s.keeper) AS gone
  FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
