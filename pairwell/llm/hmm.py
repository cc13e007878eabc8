"""Hidden Markov language model over words.

Latent states emit one of a fixed number of symbols: a frequent word, the end of the text, or a class of rarer
words (by the last two bytes). A rarer word is then drawn from its class by its smoothed frequency. Word counts
cover all training documents. So do the counts of which symbols follow which, from which the states' start values are
fitted. The states are then trained by Baum-Welch over all training documents, each as one whole sequence, with
expected counts summed across partitions. Nothing is learned from a sample.

A document's score is the exact likelihood of its whole token sequence: scaled forward recursion over the
symbols, times the words' probabilities within their classes. Frequent words' counts travel as a table of
bounded size; the counts of all other words are joined, and as none of those is frequent, no key is hot.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwell.llm.common import bucket_of, staged, table

STATES = 16
#: Words that are symbols of their own, and words whose counts travel to all tasks.
HEAD = 8192
CARRIED = 1 << 18
CLASSES = 512
#: Rounds of Baum-Welch over all training documents.
FULL_ROUNDS = 2
#: Start values: rounds over the counts of pairs of neighbours, one of which is told apart by so many groups only, which
#: bounds the table on the driver. Pairs taken at once.
PAIR_ROUNDS = 100
GROUPS = 256
PAIRS = 1 << 20
#: Symbols of documents that are run through side by side, and how many at least: fewer are run one by one.
TOGETHER = 400_000
FEW = 3
#: Symbols of one document whose forward vectors are held at once.
BLOCK = 1 << 16
#: Words counted in a task before they are handed on.
FLUSH = 400_000
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, without the end."""
    return text.encode().lower().split() if text else []


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word binary, c) over all texts; the empty word counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for x in b.column(0):
                counts.update(tokens(x.as_py()))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
            counts[END] += b.num_rows
        yield out()

    parts = docs.select(text_col).mapInArrow(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


@dataclass
class Vocabulary:
    """What tasks need to know of the words: the carried ones, and each class's totals."""

    words: list[bytes]  # carried words by falling count; the first HEAD are symbols of their own
    counts: np.ndarray
    class_tokens: np.ndarray  # tokens and distinct words of each class, head words excluded
    class_words: np.ndarray
    n: int
    v: int

    @property
    def head(self) -> int:
        return min(HEAD, len(self.words))

    @property
    def symbols(self) -> int:
        return self.head + CLASSES + 1

    @property
    def end(self) -> int:
        return self.head + CLASSES

    def symbol_table(self) -> np.ndarray:
        own = np.arange(len(self.words))
        own[self.head :] = [self.head + class_of(w) for w in self.words[self.head :]]
        return own.astype(np.int32)

    def unigram(self, ends: int) -> np.ndarray:
        """Smoothed frequency of each symbol."""
        c = np.concatenate([self.counts[: self.head], self.class_tokens, [ends]]).astype(np.float64) + 1
        return c / c.sum()


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """Vocabulary of a staged (word, c) table, and the number of training texts."""
    words = counts.where(F.octet_length("word") > 0)
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = counts.where(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0
    level = F.floor(F.log2("c") * 8).cast("int")  # some hundred levels at most
    room, floor = CARRIED, 10**6
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        if r.k > room:
            break
        room, floor = room - r.k, r.level
    rows = words.where(level >= floor).toArrow()
    ranked = sorted(zip((-c for c in rows.column("c").to_pylist()), rows.column("word").to_pylist(), strict=True))
    sums = words.groupBy((F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")) % CLASSES).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums:
        class_tokens[r.k], class_words[r.k] = r.c, r.n
    for c, w in ranked[:HEAD]:
        class_tokens[class_of(w)] += c
        class_words[class_of(w)] -= 1
    return Vocabulary([w for _, w in ranked], np.array([-c for c, _ in ranked], np.int64), class_tokens, class_words, int(n or 0), int(v or 0)), int(ends)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def first_model(unigram: np.ndarray, states: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), states))
    move = rng.gamma(2.0, 0.5, (states, states)) + 4 * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Counts:
    """Expected counts of starts, moves and emissions, and the log likelihood."""

    def __init__(self, symbols: int, states: int) -> None:
        self.rows = np.zeros((symbols + states + 2, states))
        self.symbols, self.states = symbols, states

    def model(self, unigram: np.ndarray) -> Model:
        s, k = self.symbols, self.states
        emit = self.rows[:s] + 20.0 * unigram[:, None]
        move = self.rows[s : s + k] + 1.0
        start = self.rows[s + k] + 1.0
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def add(self, symbols: np.ndarray, posterior: np.ndarray, moves: np.ndarray, starts: np.ndarray, likelihood: float) -> None:
        s, k = self.symbols, self.states
        self.rows[s : s + k] += moves
        self.rows[s + k] += starts
        self.rows[-1, 0] += likelihood
        for j in range(k):
            self.rows[:s, j] += np.bincount(symbols, posterior[:, j], s)


def expect(model: Model, sequences: list[np.ndarray], into: Counts) -> None:
    """Forward and backward over whole sequences; adds what is expected to the counts."""
    if len(sequences) < FEW:
        for s in sequences:
            _expect_one(model, s, into)
    else:
        _expect_together(model, sequences, into)


def _expect_together(model: Model, sequences: list[np.ndarray], into: Counts) -> None:
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    flat = np.concatenate([sequences[i] for i in order])
    offsets = np.cumsum(lengths) - lengths
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()  # sequences longer than t
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    read = [flat[offsets[:n] + t] for t, n in enumerate(active)]
    alphas, scales, total = [], [], 0.0
    for t, n in enumerate(active):
        a = (alphas[-1][:n] @ move if t else model.start.astype(np.float32)) * emit[read[t]]
        c = a.sum(axis=1, keepdims=True)
        a /= c
        alphas.append(a)
        scales.append(c)
        total += float(np.log(c.astype(np.float64)).sum())
    moves = np.zeros_like(model.move)
    ahead = np.zeros((0, len(model.start)), np.float32)  # of t + 1: emission times backward vector over scale
    for t in range(steps - 1, -1, -1):
        beta = np.ones_like(alphas[t])
        if len(ahead):
            beta[: len(ahead)] = ahead @ move.T
            moves += alphas[t][: len(ahead)].T @ ahead
        ahead = beta * emit[read[t]] / scales[t]
        alphas[t] *= beta  # now the posterior of the states
    into.add(np.concatenate(read), np.concatenate(alphas), moves * model.move, alphas[0].sum(axis=0), total)


def _expect_one(model: Model, symbols: np.ndarray, into: Counts) -> None:
    """One sequence, however long: only the vectors of one block are held, those of earlier ones are computed again."""
    move, emit = model.move, model.emit
    size, k = len(symbols), len(model.start)

    def forward(before: np.ndarray | None, lo: int, hi: int, alphas: np.ndarray | None, scales: np.ndarray | None) -> tuple[np.ndarray, float]:
        total = 0.0
        e = emit[symbols[lo:hi]]
        for t in range(hi - lo):
            a = (model.start if before is None else before @ move) * e[t]
            c = a.sum()
            before = a / c
            total += math.log(c)
            if alphas is not None:
                alphas[t], scales[t] = before, c
        return before, total

    starts = list(range(0, size, BLOCK))
    entry: list[np.ndarray | None] = [None]
    total = 0.0
    if len(starts) > 1:
        for lo in starts[:-1]:
            alpha, _ = forward(entry[-1], lo, lo + BLOCK, None, None)
            entry.append(alpha)
    ahead = None
    for lo, before in zip(reversed(starts), reversed(entry), strict=True):
        hi = min(lo + BLOCK, size)
        alphas, scales, aheads = np.empty((hi - lo, k)), np.empty(hi - lo), np.empty((hi - lo, k))
        total += forward(before, lo, hi, alphas, scales)[1]
        e = emit[symbols[lo:hi]] / scales[:, None]
        betas = np.ones((hi - lo, k))
        for t in range(hi - lo - 1, -1, -1):
            if ahead is not None:
                betas[t] = move @ ahead
            ahead = e[t] * betas[t]
            aheads[t] = ahead
        moves = alphas[:-1].T @ aheads[1:]
        if before is not None:
            moves += np.outer(before, aheads[0])
        first = alphas[0] * betas[0] if lo == 0 else np.zeros(k)
        into.add(symbols[lo:hi], alphas * betas, moves * move, first, 0.0)
    into.rows[-1, 0] += total


class Pools:
    """Sequences held until enough of like length can be run through together."""

    def __init__(self, model: Model, into: Counts) -> None:
        self.model, self.into = model, into
        self.held: dict[int, list[np.ndarray]] = {}
        self.sizes: Counter[int] = Counter()

    def add(self, symbols: np.ndarray) -> None:
        k = max(len(symbols).bit_length(), 9)
        self.held.setdefault(k, []).append(symbols)
        self.sizes[k] += len(symbols)
        if self.sizes[k] >= TOGETHER:
            self.run(k)

    def run(self, k: int) -> None:
        expect(self.model, self.held.pop(k), self.into)
        self.sizes[k] = 0

    def finish(self) -> None:
        for k in list(self.held):
            self.run(k)


class Reader:
    """Turns texts into symbols."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.ids = {w: i for i, w in enumerate(vocab.words)}
        self.symbol = vocab.symbol_table()

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols with the end, carried ids (-1: not carried), and the words that are not carried."""
        get, head = self.ids.get, self.vocab.head
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = np.empty(len(words) + 1, np.int32)
        out[-1] = self.vocab.end
        rare = np.flatnonzero(ids < 0)
        if len(self.symbol):
            out[:-1] = self.symbol[ids]
        others = [words[i] for i in rare.tolist()]
        out[rare] = [head + class_of(w) for w in others]
        return out, ids, others


def log_likelihoods(model: Model, sequences: list[np.ndarray], long: int = 1 << 15, part: int = 1 << 10) -> np.ndarray:
    """Natural log of each sequence's exact probability, by scaled forward recursion over all of them at once.

    Very long sequences are cut into parts whose transfer matrices (the recursion from each state) are found
    side by side and then multiplied, which is the same recursion in another order.
    """
    out = np.zeros(len(sequences))
    short = [i for i, s in enumerate(sequences) if len(s) <= long]
    if short:
        out[short] = _forward(model, [sequences[i] for i in short], np.broadcast_to(model.start, (len(short), len(model.start))))[1]
    k = len(model.start)
    for i, s in enumerate(sequences):
        if len(s) <= long:
            continue
        alpha, total = _forward(model, [s[:part]], model.start[None])
        alpha, total = alpha[0], total[0]
        rest = [s[at : at + part] for at in range(part, len(s), part)]
        for at in range(0, len(rest), 64):
            block = rest[at : at + 64]
            starts = np.tile(model.move, (len(block), 1))
            ends, logs = _forward(model, [x for x in block for _ in range(k)], starts)
            for j in range(len(block)):
                w = np.log(np.maximum(alpha, 1e-300)) + logs[j * k : (j + 1) * k]
                top = w.max()
                alpha = np.exp(w - top) @ ends[j * k : (j + 1) * k]
                total += top + np.log(alpha.sum())
                alpha /= alpha.sum()
        out[i] = total
    return out


def _forward(model: Model, sequences: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors at the ends, and the logs of the scales."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    flat = np.concatenate([sequences[i] for i in order])
    offsets = np.cumsum(lengths) - lengths
    alpha = starts[order].astype(np.float64)
    logs = np.zeros(len(order))
    for t in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        a = alpha[:n] @ model.move if t else alpha[:n]
        a = a * model.emit[flat[offsets[:n] + t]]
        c = a.sum(axis=1)
        alpha[:n] = a / c[:, None]
        logs[:n] += np.log(c)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return alpha[back], logs[back]


def _sequences(docs: DataFrame, text_col: str, shared) -> DataFrame:
    """(s binary) symbols of each text with the end, two bytes each, as there are HEAD + CLASSES + 1 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Vocabulary(**shared.value))
        for b in batches:
            rows = [reader.symbols(tokens(x.as_py()))[0].astype("<u2").tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["s"])

    return docs.select(text_col).mapInArrow(run, "s binary")


def groups_of(vocab: Vocabulary) -> np.ndarray:
    """Group of each symbol as a neighbour: its own for the end and the most frequent words, else by remainder."""
    own, ids = min(GROUPS * 3 // 4, vocab.head), np.arange(vocab.symbols)
    out = np.where(ids < own, ids, own + ids % (GROUPS - 1 - own))
    out[vocab.end] = GROUPS - 1
    return out


def pair_counts(sequences: DataFrame, shared) -> np.ndarray:
    """How often each symbol is followed (0) and preceded (1) by one of each group, over all sequences."""
    whole = Vocabulary(**shared.value)
    shape = (2, whole.symbols, GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(**shared.value)
        group, sums = groups_of(vocab), np.zeros((2, shape[1] * GROUPS), np.int64)
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2")
            for at in range(0, len(flat) - 1, PAIRS):
                part = flat[at : at + PAIRS + 1].astype(np.int64)
                inside = part[:-1] != vocab.end  # the end is a text's last symbol: no pair reaches into the next text
                first, second = part[:-1][inside], part[1:][inside]
                sums[0] += np.bincount(first * GROUPS + group[second], minlength=sums.shape[1])
                sums[1] += np.bincount(second * GROUPS + group[first], minlength=sums.shape[1])
        sums = sums.ravel()
        some = np.flatnonzero(sums)
        for at in range(0, len(some), PAIRS):
            spots = some[at : at + PAIRS]
            yield pa.RecordBatch.from_arrays([pa.array(spots.astype(np.int32)), pa.array(sums[spots])], ["spot", "n"])

    found = sequences.mapInArrow(run, "spot int, n long").groupBy("spot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(math.prod(shape))
    out[found.column("spot").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(shape)


def fit_pairs(model: Model, pairs: np.ndarray, group: np.ndarray, unigram: np.ndarray) -> Model:
    """Expectation maximization for pairs of neighbours: a state, a move, and what both states emit."""
    after, before = pairs
    start, move, emit = model.start, model.move, model.emit
    for _ in range(PAIR_ROUNDS if after.any() else 0):
        grouped = np.stack([np.bincount(group, emit[:, j], GROUPS) for j in range(len(start))], axis=1)
        joint = start[:, None] * move  # of a state and the next
        own = emit * start
        ahead = move @ grouped.T
        share = after / np.maximum(own @ ahead, 1e-300)
        seen, moves = own * (share @ ahead.T), move * (own.T @ share @ grouped)
        back = joint.T @ grouped.T
        share = before / np.maximum(emit @ back, 1e-300)
        seen += emit * (share @ back.T)
        moves += joint * (grouped.T @ share.T @ emit)
        seen, moves = seen / 2, moves / 2  # each pair is counted from both its ends
        start = (seen.sum(axis=0) + 1) / (seen.sum() + len(start))
        emit = seen + 20.0 * unigram[:, None]
        emit /= emit.sum(axis=0)
        move = (moves + 1) / (moves + 1).sum(axis=1, keepdims=True)
    return Model(start, move, emit)


def _full_round(sequences: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One round of Baum-Welch over all sequences: each task's expected counts, summed by symbol."""
    states = len(model.start)
    sent = sequences.sparkSession.sparkContext.broadcast(vars(model))  # (HEAD + CLASSES + 1) x states at most
    size = len(unigram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(size, states)
        pools = Pools(Model(**sent.value), counts)
        for b in batches:
            for x in b.column(0):
                pools.add(np.frombuffer(x.as_py(), "<u2").astype(np.int32))
        pools.finish()
        some = np.flatnonzero(counts.rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(counts.rows[some, j]) for j in range(states)]], ["row", *[f"s{j}" for j in range(states)]])

    sums = sequences.mapInArrow(run, "row long, " + ", ".join(f"s{j} double" for j in range(states)))
    total = Counts(size, states)
    found = sums.groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)]).toArrow()
    at = found.column("row").to_numpy()
    for j in range(states):
        total.rows[at, j] = found.column(f"s{j}").to_numpy()
    return total.model(unigram)


def train(docs: DataFrame, text_col: str = "text", states: int = STATES, seed: int = 1):
    """Vocabulary (broadcast), model and staged word counts of docs, which are all training documents."""
    counts = staged(word_counts(docs, text_col), "words")
    vocab, texts = vocabulary(counts)
    unigram = vocab.unigram(texts)
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocab))  # at most CARRIED words
    sequences = staged(_sequences(docs, text_col, shared), "sequences")
    model = fit_pairs(first_model(unigram, states, seed), pair_counts(sequences, shared), groups_of(vocab), unigram)
    for _ in range(FULL_ROUNDS):
        model = _full_round(sequences, model, unigram)
    return shared, model, counts


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES) -> DataFrame:
    """docs without text_col, plus held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows where held_out is false and scores all rows. A text's tokens are its lower-cased words
    and one end; null and empty texts have the end alone; all texts are learned from and scored whole. base_score: add-one unigram log10 probability; score:
    log10 probability under the model. Rows are scored each by itself, also if ids repeat. Without training rows
    all words are unknown. Columns with the names of the results are replaced; id_col is kept for callers and not read. Empty in, empty out.
    """
    marked = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    shared, model, counts = train(marked.where(~F.col("held_out")), text_col, states)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    total = Vocabulary(**shared.value).n
    names = {text_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    rest = [c for c in marked.columns if c not in names]
    kinds = {"__n": pa.int64(), "__known": pa.int64(), "__base": pa.float64(), "__score": pa.float64(), "__words": pa.list_(pa.binary()), "__times": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, fitted = Vocabulary(**shared.value), Model(**sent.value)
        reader = Reader(vocab)
        log_c = np.log10(vocab.counts + 1.0)
        of_class = np.log10(vocab.class_tokens + vocab.class_words + 1.0)
        end_c = float(vocab.n - vocab.counts[: vocab.head].sum() - vocab.class_tokens.sum())
        for b in batches:
            rows, sequences = [], []
            for x in b.column(text_col):
                symbols, ids, others = reader.symbols(tokens(x.as_py()))
                own = ids[ids >= 0]
                classed = symbols[:-1][symbols[:-1] >= vocab.head] - vocab.head
                within = log_c[own[own >= vocab.head]].sum() - of_class[classed].sum()
                base = log_c[own].sum() + np.log10(end_c + 1) - len(symbols) * np.log10(vocab.n + vocab.v + 1.0)
                times = Counter(others)
                rows.append((len(symbols), len(own) + (end_c > 0), float(base), float(within), list(times), list(times.values())))
                sequences.append(symbols)
            logs = log_likelihoods(fitted, sequences) / np.log(10) if sequences else np.zeros(0)
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * len(kinds)
            cols[3] = (np.array(cols[3]) + logs).tolist()
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], [*rest, *kinds])

    ddl = "__n long, __known long, __base double, __score double, __words array<binary>, __times array<long>"
    schema = StructType([*marked.select(*rest).schema.fields, *StructType.fromDDL(ddl).fields])
    parts = staged(marked.select(*rest, text_col).mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "scores")
    rare = parts.select("__row", F.explode(F.arrays_zip("__words", "__times")).alias("x")).select("__row", F.col("x.__words").alias("word"), F.col("x.__times").alias("t"))
    found = rare.join(counts, "word").groupBy("__row").agg(F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("__more"), F.sum("t").alias("__also"))
    out = parts.drop("__words", "__times").join(found, "__row", "left")
    more = F.coalesce("__more", F.lit(0.0))
    return out.select(
        *rest,
        F.col("__n").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__base") + more).alias("base_score"),
        (F.col("__score") + more).alias("score"),
    )


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, bucket_of(F.col("doc_id"), 7) == 2)
