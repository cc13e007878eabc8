"""Repeated strings by longest-previous-factor arrays.

A byte is removed if it lies in a string of `length` bytes that occurs elsewhere. In one text that is read off
the longest-previous-factor array: in suffix order, the longest match with an earlier place is with the
previous or the next entry of smaller position, and the longest match with a later one with those of larger
position. A corpus has no one suffix array, so equal windows are first brought together:

1. Each window of `length` bytes has an anchor, the place of its least k-gram hash. Equal windows have equal
   anchors. Windows that follow each other and share an anchor form a run, about every 170 bytes.
2. Anchors that occur once are done: none of their windows repeats. Runs that are equal as a whole are done
   too: all of their windows repeat.
3. What is left are anchors with different runs. One copy of each run's bytes goes to its anchor's group, and
   the group's suffix and longest-previous-factor arrays tell which windows repeat.
4. Groups of very many different runs are not gathered: their windows are hashed to 128 bits and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import staged, table

LENGTH = 400
GRAM = 64
#: Windows taken at once; their places fit in 20 bits.
CHUNK = (1 << 20) - 1024
#: Different runs of one anchor that one task takes.
GROUP = 4096
#: Bytes whose suffixes are sorted at once.
SORTED = 1 << 20
#: Repeated windows of crowded groups that may travel to all tasks: 16 bytes each, and 32 for the first place under
#: "first". More are joined.
CARRIED = 1 << 20
NO_ID = -(2**63)
MULTIPLIER = 0x9E3779B97F4A7C15


# --- suffix order and longest previous factors ---------------------------------------------------------------


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct ones; the order of equal keys does not matter."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix of data by its first `length` bytes, by prefix doubling; past the end counts as zero bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    width = min(8, length)
    for j in range(width):
        word = (word << np.uint64(8)) | padded[j : j + n]
    rank, have = _ranks(word), width
    while have < length:
        step = min(have, length - have)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank, have = _ranks(rank * (n + 1) + after), have + step
    return rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the nearest earlier entry of smaller value, or -1; by jumping over those already known."""
    out = np.arange(len(values)) - 1
    while True:
        wrong = np.flatnonzero((out >= 0) & (values[np.maximum(out, 0)] > values))
        if not len(wrong):
            return out
        out[wrong] = out[out[wrong]]


def repeats(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of places (rising): does its window match one at an earlier, and one at a later of them.

    The longest previous factor of a place is its match with the previous or the next smaller place in suffix
    order, so it reaches `length` if either shares the window's rank; likewise with larger places for the
    longest next factor.
    """
    rank = prefix_ranks(data, length)[places]
    order = np.argsort(rank, kind="stable")  # suffix order; equal windows by place
    ranked = rank[order]
    earlier, later = np.zeros(len(places), bool), np.zeros(len(places), bool)
    for sign, into in ((1, earlier), (-1, later)):
        spots = order * sign
        before = previous_smaller(spots)
        after = len(spots) - 1 - previous_smaller(spots[::-1])[::-1]
        found = (before >= 0) & (ranked[np.maximum(before, 0)] == ranked)
        found |= (after < len(spots)) & (ranked[np.minimum(after, len(spots) - 1)] == ranked)
        into[order] = found
    return earlier, later


def longest_previous_factors(data: bytes) -> list[int]:
    """The whole array, for one small text: matches may overlap."""
    n = len(data)
    order = sorted(range(n), key=lambda i: data[i:])
    spots = np.array(order, np.int64)
    before = previous_smaller(spots)
    after = n - 1 - previous_smaller(spots[::-1])[::-1]
    out = [0] * n
    for k, i in enumerate(order):
        for other in (before[k], after[k]):
            if 0 <= other < n:
                j, size = order[other], 0
                while i + size < n and data[i + size] == data[j + size]:
                    size += 1
                out[i] = max(out[i], size)
    return out


# --- anchors and runs ----------------------------------------------------------------------------------------


class Grams:
    """Hashes of all k-grams of a chunk, by prefix sums of powers."""

    def __init__(self, length: int) -> None:
        rng = np.random.default_rng(20)
        self.codes = rng.integers(0, 2**64, 256, np.uint64)
        base = int(rng.integers(0, 2**63)) * 2 + 1
        size = CHUNK + length
        for name, x in (("powers", base), ("inverses", pow(base, -1, 1 << 64))):
            setattr(self, name, np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=sums[1:])
        out = (sums[GRAM:] - sums[:-GRAM]) * self.inverses[: len(data) - GRAM + 1]
        out ^= out >> np.uint64(32)
        out *= np.uint64(MULTIPLIER)
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, from minima that run forward and backward in blocks."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, grams: Grams) -> dict[str, np.ndarray]:
    """Runs of windows of the texts data[starts:ends]: text, first and last window (in data), anchor hash, run hash."""
    text, lo, hi, anchor = [], [], [], []
    total = len(data)
    for at in range(0, total - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        if len(part) < length:
            break
        hashes = grams.hashes(part)
        keys = (hashes >> np.uint64(20) << np.uint64(20)) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_min(keys, length - GRAM + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        inside = np.ones(len(place), bool)
        first = np.searchsorted(ends, at, side="right")
        last = np.searchsorted(starts, at + len(part), side="left")
        for e in ends[first:last].tolist():  # windows that would cross the end of a text
            inside[max(0, e - at - length + 1) : max(0, e - at)] = False
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
        begin = np.flatnonzero(new)
        stop = np.concatenate([begin[1:], [len(place)]]) - 1
        begin, stop = begin[inside[begin]], stop[inside[begin]]
        lo.append(begin + at)
        hi.append(stop + at)
        anchor.append(hashes[place[begin]].view(np.int64))
    if not lo:
        none = np.zeros(0, np.int64)
        return {"text": none, "lo": none, "hi": none, "m": none, "r": none}
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    view = memoryview(data)
    digest = xxhash.xxh3_64_intdigest
    r = np.array([digest(view[s:e]) for s, e in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64).view(np.int64)
    real = np.flatnonzero(ends > starts)
    text = real[np.searchsorted(starts[real], lo, side="right") - 1] if len(real) else np.zeros(0, np.int64)
    return {"text": text, "lo": lo, "hi": hi, "m": np.concatenate(anchor), "r": r}


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, and where each starts and the last ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scan(docs: DataFrame, length: int, keep: str, full: bool) -> DataFrame:
    """Runs of docs(id, t, text), equal ones of a text and batch merged.

    full: (id, t, lo, hi, m, r, n), and with n = 0 the stretches lo to hi that repeat in their own text;
    otherwise only (m, r, n).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(length)
        for b in batches:
            data, offsets = _buffer(b.column("text"))
            x = runs_of(data, offsets[:-1], offsets[1:], length, grams)
            order = np.lexsort((x["lo"], x["r"], x["m"], x["text"]))
            same = np.zeros(len(order), bool)
            if len(order):
                same[1:] = (np.diff(x["text"][order]) == 0) & (np.diff(x["m"][order]) == 0) & (np.diff(x["r"][order]) == 0)
            heads = np.flatnonzero(~same)
            times = np.diff(np.concatenate([heads, [len(order)]]))
            rows = order[heads]
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(x["m"][rows]), pa.array(x["r"][rows]), pa.array(times.astype(np.int64))], ["m", "r", "n"])
                continue
            twice = np.zeros(len(order), bool)
            twice[order] = np.repeat(times > 1, times)
            if keep == "first":
                twice[rows] = False
            spot = np.flatnonzero(twice)
            joined = np.zeros(len(spot), bool)
            if len(spot):
                joined[1:] = (x["text"][spot][1:] == x["text"][spot][:-1]) & (x["lo"][spot][1:] == x["hi"][spot][:-1] + 1)
            head = np.flatnonzero(~joined)
            tail = np.concatenate([head[1:], [len(spot)]]) - 1 if len(spot) else head
            text = np.concatenate([x["text"][rows], x["text"][spot[head]]])
            lo = np.concatenate([x["lo"][rows], x["lo"][spot[head]]]) - offsets[text]
            hi = np.concatenate([x["hi"][rows], x["hi"][spot[tail]] + length]) - offsets[text]
            fill = np.zeros(len(head), np.int64)
            ids, marks = b.column("id").to_numpy(zero_copy_only=False), b.column("t").to_numpy(zero_copy_only=False)
            m = np.concatenate([x["m"][rows], (x["lo"][spot[head]] * 2654435761) ^ ids[x["text"][spot[head]]]])  # spread
            n = np.concatenate([times, fill]).astype(np.int64)
            cols = [ids[text], marks[text], lo, hi, m.astype(np.int64), np.concatenate([x["r"][rows], fill]), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "t", "lo", "hi", "m", "r", "n"])

    schema = "id long, t binary, lo long, hi long, m long, r long, n long" if full else "m long, r long, n long"
    return docs.mapInArrow(run, schema)


def _regions(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(m, id, t, lo, bytes) of the wanted(id, t, runs) runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, t, z, runs in zip(*(b.column(c).to_pylist() for c in ("id", "t", "z", "runs")), strict=True):
                data = unpack.decompress(z)
                out += [(x["m"], i, t, x["lo"], data[x["lo"] : x["hi"] + length]) for x in runs]
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["m", "id", "t", "lo", "bytes"])

    return docs.join(wanted, ["id", "t"]).mapInArrow(run, "m long, id long, t binary, lo long, bytes binary")


SPANS = "id long, t binary, lo long, hi long"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "t", "lo", "hi"])


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true flags."""
    change = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1


def _by_suffix_order(regions: DataFrame, length: int, keep: str) -> DataFrame:
    """Stretches (id, t, lo, hi) that repeat among the regions of their anchor."""

    def solve(rows: list[tuple]) -> list[tuple]:
        data = np.frombuffer(b"".join(x[4] for x in rows), np.uint8)
        sizes = np.array([len(x[4]) for x in rows])
        starts = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        places = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        earlier, later = repeats(data, places, length)
        hit = earlier if keep == "first" else earlier | later
        out, at = [], 0
        for (_, i, t, lo, _), k in zip(rows, counts.tolist(), strict=True):
            for s, e in zip(*_stretches(hit[at : at + k]), strict=True):
                out.append((i, t, lo + int(s), lo + int(e) + length))
            at += k
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("m", "id", "t", "lo", "bytes")), strict=True):
                if size >= SORTED and row[0] != held[-1][0]:
                    yield _spans(solve(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield _spans(solve(held))

    return regions.repartition("m").sortWithinPartitions("m", "id", "t", "lo").mapInArrow(run, SPANS)


def _carried(seen: DataFrame) -> tuple[np.ndarray, ...]:
    """The columns of seen(w, or w, id, t, lo) as arrays of fixed width, sorted by w."""
    rows = seen.toArrow()  # at most CARRIED
    cols = [np.array(rows.column(c).to_pylist(), "S16") if c in ("w", "t") else rows.column(c).to_numpy() for c in rows.column_names]
    order = np.argsort(cols[0])
    return tuple(x[order] for x in cols)


def _by_window_hash(regions: DataFrame, length: int, keep: str) -> DataFrame:
    """The same for anchors of very many runs: windows are hashed and counted, wherever they are."""
    regions = regions.repartition("id", "lo")

    def hashes(row: tuple) -> list[bytes]:
        digest, view = xxhash.xxh3_128_digest, memoryview(row[3])
        return [digest(view[p : p + length]) for p in range(len(view) - length + 1)]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("id", "t", "lo", "bytes")), strict=True)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[bytes, tuple] = {}

        def batch() -> pa.RecordBatch:
            cols = [list(out), *[[v[j] for v in out.values()] for j in range(4)]]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["w", "n", "id", "t", "lo"])

        for row in rows_of(batches):
            for p, h in enumerate(hashes(row)):
                at = (row[0], row[1], row[2] + p)
                n, *first = out.get(h, (0, *at))
                out[h] = (n + 1, *min(tuple(first), at))
            if len(out) > 100_000:
                yield batch()
                out.clear()
        yield batch()

    seen = regions.mapInArrow(windows, "w binary, n long, id long, t binary, lo long")
    seen = seen.groupBy("w").agg(F.sum("n").alias("n"), F.min(F.struct("id", "t", "lo")).alias("first")).where("n > 1")
    seen = staged(seen.select("w", "first.*"), "windows")
    if seen.count() <= CARRIED:
        sent = regions.sparkSession.sparkContext.broadcast(_carried(seen if keep == "first" else seen.select("w")))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, *first = sent.value
            out = []
            for row in rows_of(batches):
                own = np.array(hashes(row), "S16")
                flags = np.zeros(len(own), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    flags = known[at] == own
                    if first:
                        ids, marks, los = first
                        flags &= (ids[at] != row[0]) | (marks[at] != row[1]) | (los[at] != row[2] + np.arange(len(own)))
                out += [(row[0], row[1], row[2] + int(s), row[2] + int(e) + length) for s, e in zip(*_stretches(flags), strict=True)]
                if len(out) > 10_000:
                    yield _spans(out)
                    out = []
            yield _spans(out)

        return regions.mapInArrow(mark, SPANS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = hashes(row)
            n = len(keys)
            cols = [pa.array(keys, pa.binary()), pa.array([row[0]] * n, pa.int64()), pa.array([row[1]] * n, pa.binary()), pa.array(range(row[2], row[2] + n), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["w", "id", "t", "lo"])

    each = regions.mapInArrow(places, "w binary, id long, t binary, lo long").alias("p")
    both = each.join(seen.alias("f"), "w")
    if keep == "first":
        both = both.where("p.id <> f.id or p.t <> f.t or p.lo <> f.lo")
    return both.select("p.id", "p.t", "p.lo", (F.col("p.lo") + length).alias("hi"))


def repeated_spans(slim: DataFrame, packed: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(id, t, lo, hi) stretches of bytes to remove from slim(id, t, text); they may overlap.

    packed(id, t, z) has the same texts compressed, as they are to be shuffled.
    """
    anchors = _scan(slim, length, keep, False).groupBy("m").agg(F.sum("n").alias("n"), F.min("r").alias("a"), F.max("r").alias("b"))
    anchors = staged(anchors.where("n > 1").select("m", (F.col("a") < F.col("b")).alias("mixed")), "anchors")
    runs = staged(_scan(slim, length, keep, True).join(anchors, "m", "left").where("n = 0 or mixed is not null"), "runs")
    own = runs.where("n = 0").select("id", "t", "lo", "hi")
    place = F.struct("id", "t", "lo", "hi")
    classes = runs.where("n > 0").groupBy("m", "r").agg(F.sum("n").alias("n"), F.min(place).alias("first"), F.first("mixed").alias("mixed"))
    classes = staged(classes, "classes")
    twice = classes.where("n > 1").select("m", "r", "first")
    whole = runs.where("n > 0").drop("n", "mixed").join(twice, ["m", "r"])
    if keep == "first":
        whole = whole.where(F.col("first") != place)
    whole = whole.select("id", "t", "lo", (F.col("hi") + length).alias("hi"))
    wanted = classes.where("mixed").select("first.*", "m").groupBy("id", "t").agg(F.collect_list(F.struct("lo", "hi", "m")).alias("runs"))
    regions = staged(_regions(packed, wanted, length), "regions")
    crowded = staged(regions.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("m"), "crowded")
    out = own.unionAll(whole).unionAll(_by_suffix_order(regions.join(crowded, "m", "left_anti"), length, keep))
    if crowded.isEmpty():
        return out
    return out.unionAll(_by_window_hash(regions.join(crowded, "m", "left_semi").select("id", "t", "lo", "bytes"), length, keep))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs with text_col as the UTF-8 bytes that stay (binary), plus n_bytes, n_removed and n_spans (long).

    Every string of `length` bytes that occurs at another place, in the same text or another, is removed:
    with keep "first" from all places but the first (by id, then place), with keep "none" from all. Overlapping
    occurrences count, all is judged on the input, and matches never cross texts. n_spans counts the maximal
    removed stretches. digest: text_col becomes the hex SHA-256 of those bytes.

    Null text is empty; shorter texts stay whole. A null id sorts first. Rows with the same id and text are
    places of their own under "none", and are all treated as the first is under "first". Columns with the
    names of the results are replaced. Empty in, empty out.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("t")
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans")]
    own = [f"c{k}" for k in range(len(rest))]
    slim = docs.select(*key, F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, own, strict=True)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [packer.compress((x.as_py() or "").encode()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "t", *own)] + [pa.array(z, pa.binary())], ["id", "t", *own, "z"])

    packed = slim.mapInArrow(pack, slim.select("id", "t", *own).schema.add("z", "binary"))
    spans = repeated_spans(slim.select("id", "t", "text"), packed.select("id", "t", "z"), length, keep)
    spans = spans.groupBy("id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts, counts = [], []
            for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data, parts, at, removed, n = unpack.decompress(z), [], 0, 0, 0
                stop = -1  # end of the stretch being removed
                for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or []):
                    if lo > stop:
                        parts.append(data[at:lo])
                        n += 1
                        stop = lo
                    removed += max(0, hi - max(lo, stop))
                    at = stop = max(stop, hi)
                parts.append(data[at:])
                kept = b"".join(parts)
                texts.append(hashlib.sha256(kept).hexdigest() if digest else kept)
                counts.append((len(data), removed, n))
            cols = [list(c) for c in zip(*counts, strict=True)] or [[]] * 3
            arrays = [b.column(c) for c in own] + [pa.array(texts, pa.string() if digest else pa.binary()), *[pa.array(c, pa.int64()) for c in cols]]
            yield pa.RecordBatch.from_arrays(arrays, [*own, "text", "n_bytes", "n_removed", "n_spans"])

    schema = slim.select(*own).schema.add("text", "string" if digest else "binary")
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    out = packed.join(spans, ["id", "t"], "left").select(*own, "z", "spans").mapInArrow(cut, schema)
    return out.toDF(*rest, text_col, "n_bytes", "n_removed", "n_spans")


def query(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="none", digest=True)
    return out.withColumnRenamed("text", "kept_sha256")
