"""Benchmark decontamination by a prefix-filtered join of shingles.

Only DataFrame functions. An item window of 13 words can occur in a document only if each of its 4-word
shingles does, so one shingle, the one that is rarest among all documents, is enough to look for: the
prefix of an exact containment join has length one. A hit fixes where the window would start; positions
and lengths that do not fit are dropped, and what is left is compared word for word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import ascii_lower, let, sized as small, staged, table

#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_ID = -(2**63)
#: Shingles or windows of the benchmark that may travel to all tasks.
CARRIED = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of width words, by position; empty for shorter texts."""

    def hashed(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    return let(words, hashed)


def item_windows(bench: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(win, words, items): each distinct window with the ids of its items."""
    items = bench.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("all")).where("size(all) > 0")
    at = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    wins = items.select("item", F.explode(F.transform(at, lambda i: F.slice(F.col("all"), i + 1, window))).alias("words"))
    return wins.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("win"), "words", "items")


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 13,
    shingle: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document that holds a window: (doc, n_words, hits array<struct<start, len, items>>), found exactly.

    A window is any 13 consecutive words of an item, or the whole item if it has fewer (but some). Null text
    has no words. Rows with the same id are compared each by itself (see whole_document_key). A null item id
    counts for hits but is no item.
    """
    windows = staged(item_windows(bench, window, item_col, item_text_col), "windows")
    sized = windows.withColumn("width", F.least(F.size("words"), F.lit(shingle)))
    widths = sorted(r[0] for r in sized.select("width").distinct().collect())  # at most `shingle` numbers
    keyed = docs.select(whole_document_key(id_col, text_col).alias("doc"), words_of(F.col(text_col)).alias("words"))
    hit_type = "array<struct<start:int,len:int,items:array<bigint>>>"
    if not widths:
        return keyed.select("doc", F.size("words").alias("n_words"), F.lit(None).cast(hit_type).alias("hits")).where("false")
    places = []
    for width in widths:
        of = sized.where(F.col("width") == width)
        places.append(of.select("win", F.size("words").alias("len"), F.lit(width).alias("width"), F.posexplode(shingles(F.col("words"), width)).alias("off", "key")))
    places = staged(reduce(DataFrame.unionAll, places), "shingles")
    seen = occurrences(keyed, places, widths).groupBy("width", "key").agg(F.count(F.lit(1)).alias("n"))
    rarest = places.join(staged(seen, "rarity"), ["width", "key"]).groupBy("win", "len").agg(F.min(F.struct("n", "off", "width", "key")).alias("first"), F.count(F.lit(1)).alias("found"))
    # a window can only occur where all of its shingles do
    prefix = rarest.where(F.col("found") == F.col("len") - F.col("first.width") + 1).select("win", "len", "first.off", "first.width", "first.key")
    prefix = staged(prefix.join(windows.select("win", F.col("words").alias("window"), "items"), "win"), "prefix")
    few = prefix.count() <= CARRIED
    starts = occurrences(keyed, prefix, widths, words=few).join(F.broadcast(prefix) if few else prefix, ["width", "key"])
    starts = starts.withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    if not few:  # the words of the documents that are left come back by a join
        starts = starts.select("doc", "start", "len", "window", "items").join(keyed.dropDuplicates(["doc"]), "doc")
    fits = (F.col("start") + F.col("len") <= F.size("words")) & (F.slice(F.col("words"), F.col("start") + 1, F.col("len")) == F.col("window"))
    found = starts.where(fits).select("doc", F.size("words").alias("n_words"), F.struct("start", "len", "items").alias("hit"))
    return found.groupBy("doc", "n_words").agg(F.collect_set("hit").alias("hits"))


def occurrences(keyed: DataFrame, wanted: DataFrame, widths: list[int], words: bool = False) -> DataFrame:
    """(doc, width, key, pos) wherever a document has one of the wanted(width, key) shingles; also its words, if asked.

    Up to CARRIED keys are looked up while a document is read, so that nothing else leaves the scan; more are joined.
    """
    keys = wanted.select("width", "key").distinct()
    if not words and keys.count() > CARRIED:
        each = [keyed.select("doc", F.lit(w).alias("width"), F.posexplode(shingles(F.col("words"), w)).alias("pos", "key")) for w in widths]
        return reduce(DataFrame.unionAll, each).join(keys, ["width", "key"])
    by_width: dict[int, list[int]] = {w: [] for w in widths}
    for r in keys.collect():  # at most CARRIED
        by_width[r.width].append(r.key)
    found = []
    for w, some in by_width.items():
        found.append(_places(shingles(F.col("words"), w), w, some))
    rest = ["words"] if words else []
    rows = keyed.select("doc", *rest, F.concat(*found).alias("found"))
    return rows.select("doc", *rest, F.explode("found").alias("f")).select("doc", *rest, "f.*")


def _places(keys: Column, width: int, wanted: list[int]) -> Column:
    at = F.transform(keys, lambda k, i: F.struct(F.lit(width).alias("width"), k.alias("key"), i.alias("pos")))
    return F.filter(at, lambda x: x["key"].isin(wanted))


def whole_document_key(id_col: str, text_col: str) -> Column:
    """Identifies a row by id and text, so that rows that share an id are told apart."""
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def mark_leaks(docs: DataFrame, bench: DataFrame, max_share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without text_col, plus n_words, n_hit, n_items, items (strings in order) and contaminated.

    A word inside any occurrence of a window is hit. contaminated: some word is hit and at least max_share of
    all words are. Null or empty text: no words, not contaminated. Each row is judged by itself, also if ids
    repeat. Columns with the names of the results are replaced. Empty documents give an empty table; an empty
    benchmark hits nothing.
    """
    leaks = find_leaks(docs, bench, id_col=id_col, text_col=text_col, **kw)
    spots = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.col("hits.items")), lambda i: i.cast("string"))))
    leaks = staged(leaks.select(F.col("doc").alias("__doc"), F.size(F.array_distinct(spots)).cast("long").alias("__hit"), items.alias("__items")), "hit")
    out = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in {text_col, "n_words", "n_hit", "n_items", "items", "contaminated"}],
        F.size(words_of(F.col(text_col))).cast("long").alias("n_words"),
        whole_document_key(id_col, text_col).alias("__key"),
    ).join(leaks, F.col("__key") == F.col("__doc"), "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"n_hit": F.coalesce("__hit", F.lit(0).cast("long")), "items": F.coalesce("__items", empty)})
    out = out.withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(max_share) * F.col("n_words")))
    return out.drop("__key", "__doc", "__hit", "__items")


def drop_leaks(docs: DataFrame, bench: DataFrame, max_share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that mark_leaks does not call contaminated, unchanged."""
    leaks = find_leaks(docs, bench, id_col=id_col, text_col=text_col, **kw)
    spots = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    over = F.size(F.array_distinct(spots)) >= F.lit(max_share) * F.col("n_words")
    bad = small(staged(leaks.where(over).select(F.col("doc").alias("__doc")), "leaks"))
    return docs.join(bad, whole_document_key(id_col, text_col) == F.col("__doc"), "left_anti")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated.alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
spots AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p + unnest(range(0, n)) AS q FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)
"""
