"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 23, 23 and 18 bits. Where two fingerprints differ in at
most four bits, the two segments that differ least do so in at most two bits each (pigeonhole). The binary
Golay code [23, 12, 7] is perfect: a word is within three bits of exactly one codeword. A word's keys are the
12-bit indices of all codewords within three bits, or within four for words at distance exactly three (1 + 5
codewords); any two words that differ in at most two bits share a key. So the pairs of keys of two segments
(85 on average for all three choices of two) bring together every pair of fingerprints that has to be found.
Each meeting is verified by counting the differing bits.

There are three times 2^24 keys, so with very many fingerprints each key holds many. Keys that do are made
longer: of the two segments one is equal, or both differ in one bit and the third in at most two. So a row of a
crowded key goes on under that key with either segment's own bits, and with each key of the third segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import staged, table
from pairwell.llm.components import components

#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: the seed of XXH64.
SEED = 42
MAX_BITS = 4
#: Fingerprints of one key that are compared in one block; keys with more are made longer.
BLOCK = 4096
#: Counters of hashed keys, by which most keys are seen not to be crowded.
CELLS = 1 << 14


def syndrome(word: int) -> int:
    """Remainder of a 23-bit word by the generator."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and by syndrome up to six error patterns (-1: none)."""
    low = np.array([syndrome(x) for x in range(4096)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(2048)], np.int64)
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    single = [syndrome(1 << i) for i in range(23)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = error = 0
            for i in bits:
                s ^= single[i]
                error |= 1 << i
            if weight < 4 or patterns[s, 0] == -1 or int(patterns[s, 0]).bit_count() == 3:
                patterns[s, used[s]] = error
                used[s] += 1
    return low, high, patterns


def segment_keys(words: np.ndarray, tables: tuple) -> np.ndarray:
    """(n, 6) indices of the codewords near each 23-bit word, -1 where there are fewer."""
    low, high, patterns = tables
    errors = patterns[low[words & 4095] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def pair_keys(prints: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """All keys of int64 fingerprints: (key, index of the fingerprint)."""
    bits = prints.view(np.uint64)
    near = [segment_keys(((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64), tables) for at, size in SEGMENTS]
    keys, rows = [], []
    for family, (i, j) in enumerate(PAIRS):
        a, b = near[i][:, :, None], near[j][:, None, :]
        ok = (a >= 0) & (b >= 0)
        keys.append((((family << 24) | (a << 12) | b)[ok]))
        rows.append(np.nonzero(ok)[0])
    return np.concatenate(keys), np.concatenate(rows)


def longer_keys(keys: np.ndarray, prints: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(long key, row) of rows (key, fingerprint): the key with the bits of either of its segments, or with a key of the third.

    A long key has the key in its low 26 bits, then which of the three it is, and 23 bits of that.
    """
    bits = prints.view(np.uint64)
    words = [((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    out, rows = [], []
    for family, (i, j) in enumerate(PAIRS):
        mine = np.flatnonzero(keys >> 24 == family)
        third = segment_keys(words[3 - i - j][mine], tables)
        parts = [words[i][mine][:, None], words[j][mine][:, None], third]
        for kind, part in enumerate(parts):
            ok = part >= 0
            out.append((keys[mine][:, None] | kind << 26 | np.maximum(part, 0) << 28)[ok])
            rows.append(np.broadcast_to(mine[:, None], part.shape)[ok])
    return np.concatenate(out), np.concatenate(rows)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the word shingles, as a signed 64-bit integer; zero without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes (uint64) of the word shingles, repeats included; a shorter text is one shingle, a blank one has none."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64, n - shingle + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """docs without text_col, plus fp (long)."""
    rest = [c for c in docs.columns if c not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(x.as_py(), shingle) for x in b.column(text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [prints], [*rest, "fp"])

    return docs.select(*rest, text_col).mapInArrow(run, docs.select(*rest).schema.add("fp", "long"))


def _connect(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (uint64), by search from one to its neighbours."""
    rest = prints
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                frontier.extend(found)
                for y in found.tolist():
                    yield int(x), y


def forest(groups: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links within each run of equal group numbers that suffice to connect what is linked."""
    n = len(groups)
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if n else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    small = np.repeat(sizes <= 32, sizes)
    linked = np.zeros(len(sizes), bool)
    linked[sizes > 32] = True
    which = np.repeat(np.arange(len(sizes)), sizes)
    for shift in range(1, min(32, n)):
        at = np.flatnonzero((groups[shift:] == groups[:-shift]) & small[shift:])
        if not len(at):
            break
        close = at[np.bitwise_count(prints[at] ^ prints[at + shift]) <= MAX_BITS]
        linked[which[close]] = True
    for k in np.flatnonzero(linked).tolist():
        lo, hi = edges[k], edges[k + 1]
        if hi - lo == 2:
            yield int(prints[lo]), int(prints[lo + 1])
        else:
            yield from _connect(prints[lo:hi])


def _links(rows: DataFrame) -> DataFrame:
    """Links (a, b) among rows (key, cell, fp); those of a partition form a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def links(group: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            out = []
            for x, y in forest(group, prints):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[rx] = ry
                    out.append((x, y))
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            part = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "cell", "fp")])
            held.append(part)
            if sum(x.shape[1] for x in held) < 500_000:
                continue
            part = np.concatenate(held, axis=1)
            last = (part[0] == part[0, -1]) & (part[1] == part[1, -1])  # its group may go on
            cut = int(np.argmax(last))
            held = [part[:, cut:]]
            if cut:
                yield links(_group_numbers(part[:, :cut]), part[2, :cut].copy().view(np.uint64))
        if held:
            part = np.concatenate(held, axis=1)
            yield links(_group_numbers(part), part[2].copy().view(np.uint64))

    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a long, b long")


def _group_numbers(part: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[False, (part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])])


def link_forest(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is connected among the distinct fingerprints of prints(fp).

    Keys with more than BLOCK fingerprints are made longer. Long keys that still have more (fingerprints that are
    nearly all alike) are dealt into blocks, and each pair of blocks is compared in a task of its own. Whether
    there can be crowded keys is seen from counts of hashed keys, which are at least as large.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 10_000):
                key, row = pair_keys(fp[at : at + 10_000], tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at : at + 10_000][row])], ["key", "fp"])

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            key, row = longer_keys(b.column("key").to_numpy(zero_copy_only=False), fp, tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 10_000):
                key, _ = pair_keys(fp[at : at + 10_000], tables)
                total += np.bincount((key * 40503 >> 7) % CELLS, minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    def parted(rows: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of keys that are not crowded, and those that are, with their number of blocks."""
        return rows.join(crowded.select("key"), "key", "left_anti"), rows.join(crowded, "key")

    def over(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        return staged(n.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")

    prints = staged(prints, "prints")
    rows = prints.mapInArrow(keys, "key long, fp long")
    cells = staged(prints.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK), "cells")
    if cells.isEmpty():
        return _links(rows.withColumn("cell", F.lit(0)))
    cell_of = F.shiftright(F.col("key") * 40503, 7) % CELLS
    suspects = rows.withColumn("cell", cell_of).join(F.broadcast(cells.select("cell")), "cell", "left_semi")  # at most CELLS numbers
    cold, hot = parted(rows, over(suspects))
    long = hot.select("key", "fp").mapInArrow(lengthen, "key long, fp long")
    cool, crowded = parted(long, over(long))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    dealt = crowded.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.greatest("own", "other") * (F.greatest("own", "other") + 1) / 2 + F.least("own", "other") + 1
    blocks = dealt.select("key", "fp", pair.cast("int").alias("cell"))
    # keys and long keys are apart: a long key of a crowded key is at least that key, which is crowded itself
    return _links(cold.unionAll(cool).withColumn("cell", F.lit(0)).unionAll(blocks))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """docs without text_col, plus fp (long) and component_id (long).

    Fingerprints at four or fewer differing bits are linked, and component_id is the smallest id reachable
    over links, the own one included. Equal fingerprints are one node, so exact copies cost nothing here.

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts are taken whole, however
    long. Null ids take part but are no component_id; rows with the same id are rows of their own. Columns named fp
    or component_id are replaced. Empty in, empty out.
    """
    prints = staged(with_fingerprint(docs.drop("component_id"), text_col, shingle), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("least")), "nodes")
    stars = components(staged(link_forest(nodes.select("fp")), "forest"))
    stars = staged(stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct()), "stars")
    members = stars.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "least")
    roots = members.groupBy("root").agg(F.min("least").alias("component"))
    named = staged(members.join(roots, "root").select(F.col("node").alias("fp"), "component"), "components")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(named, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row of docs for each component: that of the smallest id (by text hash among rows with that id).

    Components are named by their least text hash, as ids may be null or repeat; null ids come last. Null, empty and
    blank texts are one group. Columns stay as they are. Empty in, empty out.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    members = near_duplicates(slim, "h", "text", shingle)
    best = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "h")
    keep = members.groupBy("component_id").agg(F.min(best).alias("best"))
    keep = staged(keep.select(F.col("best.id").alias("__id"), F.col("best.h").alias("__h")), "kept")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.join(keep, (key[0] == F.col("__id")) & (key[1] == F.col("__h")))
    return out.dropDuplicates(["__id", "__h"]).drop("__id", "__h")


def query(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
