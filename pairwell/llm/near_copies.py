"""Near copies: SimHash with exact verification, and what fingerprints cannot tell by a prefix filter.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; groups are what
links connect. Pairs come from three sources, each verified on the whole sets:

1. Fingerprints of those shingles that differ in at most four of 64 bits, found by Golay-code keys (see simhash).
2. At 0.8 fingerprints differ in some ten bits, which no bound reaches that still tells texts apart. So what is not
   connected yet meets by a prefix filter: where shingles have one order for all texts, two sets that are that
   similar share a shingle among the first n - ceil(0.8 n) + 1 of each. First each text is compared with
   a few others at each shingle that belong to another group, so that most of a large group of near copies is
   connected by about as many comparisons as it has members.
3. Then all pairs that meet and still belong to different groups are compared, so that no link is lost.

The order puts the shingles that repeat in a bounded sample of texts last, by their number; this decides only how
many pairs meet, not which are found. Parities of the shingles by hash bound from below how many differ; only pairs
that may still be similar are verified. Texts of the same set are one node, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import sized, staged
from pairwell.llm.components import components
from pairwell.llm.simhash import fingerprint_of, link_forest, shingle_hashes

SHINGLE = 5
#: Similarity that links, as a fraction.
NEAR = (4, 5)
SEED = 42
#: Texts that tell which shingles are frequent, and shingles that are carried to all tasks (16 bytes each).
SAMPLE_DOCS = 4000
FREQUENT = 1 << 16
#: Turns in which texts meet a few partners at each key, before all that are left meet, and how many. Both change the
#: number of comparisons only.
TURNS = 1
PARTNERS = 3
#: Rows held in a task before groups are paired.
HELD = 100_000
#: Bytes of parities that travel with each key.
SHORT = 64
PAIRS = "a long, b long"


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes (uint64) of the distinct shingles; a shorter text is one shingle, a blank one has none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two non-empty shingle sets are near copies."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(x) + len(y) - both)


def parities(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls in each of n to 2 n cells (64 at least)."""
    cells = 1 << max(6, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def may_be_similar(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False only where the parities of sets of n and m shingles show that the sets are not near copies."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        a, b = (b, a) if len(a) < len(b) else (a, b)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    differ = int(np.bitwise_count(a ^ b).sum(dtype=np.int64))
    return (NEAR[1] - NEAR[0]) * (n + m) >= (NEAR[1] + NEAR[0]) * differ


def halved(p: bytes) -> bytes:
    """The parities of half as many cells."""
    a = np.frombuffer(p, np.uint8)
    return (a[: len(a) // 2] ^ a[len(a) // 2 :]).tobytes()


def shortened(p: bytes) -> bytes:
    while len(p) > SHORT:
        p = halved(p)
    return p


def _words(parts: list[bytes]) -> np.ndarray:
    """Parities as rows of equal width, zeros behind."""
    return np.frombuffer(b"".join(x.ljust(SHORT, b"\0") for x in parts), np.uint64).reshape(len(parts), SHORT // 8)


class Sketches:
    """Short parities of many sets, by which one set is held against several."""

    def __init__(self, parts: list[bytes], n: np.ndarray) -> None:
        self.n, self.size = n, np.array([len(x) for x in parts])
        self.full, self.half = _words(parts), _words([halved(x) if len(x) > 8 else b"" for x in parts])

    def may_be_similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of others may be near copies of i. Sets that fit in size have as many cells, half or twice as many."""
        ok = _fits(self.n[i], self.n[others])
        for mine, theirs, ratio in ((self.full, self.full, 1), (self.full, self.half, 2), (self.half, self.full, 0.5)):
            at = np.flatnonzero(ok & (self.size[others] == ratio * self.size[i]))
            if len(at):
                differ = np.bitwise_count(mine[i] ^ theirs[others[at]]).sum(axis=1, dtype=np.int64)
                ok[at] = (NEAR[1] - NEAR[0]) * (self.n[i] + self.n[others[at]]) >= (NEAR[1] + NEAR[0]) * differ
        return ok


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles by (sampled count, hash); frequent is sorted."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, counts[at], 0)
    order = np.lexsort((shingles, rank))
    return shingles[order[: n + 1 + (-NEAR[0] * n // NEAR[1])]]


def frequent_shingles(slim: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that most often repeat in the sample of slim(text)."""
    total = slim.count()
    unit = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], ["s"])

    counts = slim.where(unit * total <= SAMPLE_DOCS).select("text").distinct().mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    hashes = top.column("s").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top.column("n").to_numpy().astype(np.int64)[order]


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[np.ndarray]:
    """int64 columns of rows sorted by the first; rows of one key are never parted."""
    for part, _ in _parts(batches, names, None):
        yield part


def _parts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], extra: str | None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The same, with a binary column."""
    held: list[np.ndarray] = []
    more: list[bytes] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        if extra:
            more += b.column(extra).to_pylist()
        held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]))
        size += b.num_rows
        if size < HELD or held[-1][0, -1] == held[0][0, 0]:
            continue
        part = np.concatenate(held, axis=1)
        cut = int(np.argmax(part[0] == part[0, -1]))  # its group may go on
        yield part[:, :cut], more[:cut]
        held, size, more = [part[:, cut:]], part.shape[1] - cut, more[cut:]
    if held:
        yield np.concatenate(held, axis=1), more


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return NEAR[1] * np.minimum(n, m) >= NEAR[0] * np.maximum(n, m)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _met(rows: DataFrame) -> DataFrame:
    """Those of rows(key, node, n, q) whose key others have too, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q in _parts(batches, ("key", "node", "n"), "q"):
            same = part[0, 1:] == part[0, :-1]
            at = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
            cols = [pa.array(part[k, at].copy()) for k in range(3)] + [pa.array([q[i] for i in at.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "node", "n", "q"])

    return staged(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long, n long, q binary"), "met")


def _other_pairs(met: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of nodes at one key of met(key, node, n, q, root) whose roots differ and that may be near copies by q.

    Of the parts of a key that have one root each, the largest meets the others row by row of theirs. most: only so
    many partners of each row, drawn at random; without it all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, root, n, node), q in _parts(batches, ("key", "root", "n", "node"), "q"):
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            open_ = root[edges[:-1]] != root[edges[1:] - 1]
            if not open_.any():
                continue
            sketches = Sketches(q, n)
            rng = np.random.default_rng(len(key))
            left, right, size = [], [], 0
            for lo, hi in zip(edges[:-1][open_].tolist(), edges[1:][open_].tolist(), strict=True):
                ends = np.flatnonzero(np.r_[root[lo + 1 : hi] != root[lo : hi - 1], True]) + lo + 1
                starts = np.r_[lo, ends[:-1]]
                main = int(np.argmax(ends - starts))
                for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    if k == main:
                        continue
                    rest = np.arange(e, hi)
                    if main < k:
                        rest = np.r_[np.arange(starts[main], ends[main]), rest]
                    for i in range(s, e):
                        j = rest[sketches.may_be_similar(i, rest)]
                        if most is not None and len(j) > most:
                            j = rng.choice(j, most, replace=False)
                        left.append(np.full(len(j), node[i]))
                        right.append(node[j])
                        size += len(j)
                        if size > HELD:
                            yield _pairs(np.concatenate(left), np.concatenate(right))
                            left, right, size = [], [], 0
            if size:
                yield _pairs(np.concatenate(left), np.concatenate(right))

    return met.repartition("key").sortWithinPartitions("key", "root", "n", "node").mapInArrow(run, PAIRS).distinct()


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that may be near copies by the parities in nodes(node, n, p)."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("na", "nb", "pa", "pb")], strict=True)
            yield b.select(["a", "b"]).filter(pa.array([may_be_similar(*r) for r in rows], pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, PAIRS)


def _verified(pairs: DataFrame, sets: DataFrame, slim: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that are near copies by the texts in slim(id, h, text) of the nodes in sets(id, h, node)."""
    pairs = staged(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    places = sets.join(wanted, "node").groupBy("node").agg(F.min(F.struct("id", "h")).alias("at"))
    places = sized(staged(places.select("node", "at.*"), "places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = pa.array([shingle_set(x.as_py()).tobytes() for x in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), z], ["node", "z"])

    texts = slim.join(places, ["id", "h"]).select("node", "text").mapInArrow(read, "node long, z binary")
    texts = staged(texts.groupBy("node").agg(F.first("z").alias("z")), "wanted")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = zip(b.column("x"), b.column("y"), strict=True)
            ok = pa.array([similar(*(np.frombuffer(z.as_buffer(), np.uint64) for z in side)) for side in sides], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    return staged(both.select("a", "b", "x", "y").mapInArrow(run, PAIRS), "similar")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, root) for each row of docs: its id, its text's hash, and a number that its group alone has.

    A null id is the greatest. Null, empty and blank texts are one group. Texts are taken whole. Empty in, empty out.
    """
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id")
    slim = docs.select(ident, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    frequent, counts = frequent_shingles(slim)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))  # at most FREQUENT shingles

    def described(text: str | None) -> tuple:
        hashes = shingle_hashes(text, SHINGLE)
        own = np.unique(hashes)
        node = xxhash.xxh64_intdigest(own.tobytes(), SEED)
        return fingerprint_of(hashes), node - (node >> 63 << 64), len(own), prefix(own, *sent.value).view(np.int64), (p := parities(own)), shortened(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [described(x.as_py()) for x in b.column("text")]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "h", "fp", "node", "n", "keys", "p", "q"])

    sets = staged(slim.mapInArrow(run, "id long, h long, fp long, node long, n long, keys array<long>, p binary, q binary"), "sets")
    prints = staged(sets.groupBy("node").agg(F.first("fp").alias("fp")), "prints")
    least = staged(prints.groupBy("fp").agg(F.min("node").alias("least")), "least")
    forest = link_forest(least.select("fp"))
    ends = forest.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = prints.join(least, "fp").where("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    alike = ends.select("x", "y").unionAll(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = _verified(alike, sets, slim)

    nodes = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("q").alias("q"))
    met = _met(nodes.select(F.explode("keys").alias("key"), "node", "n", "q"))
    nodes = sets.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("p").alias("p"))
    nodes = staged(nodes, "nodes")
    rooted = lambda roots: met.join(roots, "node", "left").select("key", "node", "n", "q", F.coalesce("root", "node").alias("root"))
    # at first a node's root is just the least of its neighbours, as it only saves comparisons
    near = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
    stars = near.select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
    for _ in range(TURNS):
        links = links.unionAll(_verified(_plausible(_other_pairs(rooted(stars), PARTNERS), nodes), sets, slim))
        stars = staged(components(links), "stars")
    more = _verified(_plausible(_other_pairs(rooted(stars)), nodes), sets, slim)
    if not more.isEmpty():
        stars = staged(components(links.unionAll(more)), "stars")
    return sets.join(stars, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group: that of the smallest id (by text hash among rows with that id), unchanged.

    Of rows with the same id and text one stays. Null ids come last; null, empty and blank texts are one group.
    """
    keep = near_copies(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct("id", "h")).alias("best"))
    keep = staged(keep.select(F.col("best.id").alias("__id"), F.col("best.h").alias("__h")), "kept")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.join(keep, (key[0] == F.col("__id")) & (key[1] == F.col("__h")))
    return out.dropDuplicates(["__id", "__h"]).drop("__id", "__h")
