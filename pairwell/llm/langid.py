"""Language ID by string kernels.

The kernel of two texts is the number of distinct 1- to 4-grams of code points that both hold, over the
geometric mean of how many each holds (a blended-spectrum presence kernel). Landmarks drawn from the labelled
rows span a Nyström approximation of it, on which one-versus-rest ridge regressions are fitted. n-grams are
hashed to 2**18 features.

Scoring: with X the 0/1 block of a batch's texts, L the landmarks' rows and A the fitted weights, the scores
are (X L') A over the texts' norms. The product is taken as X (L' A), which is the same and needs only one
matrix product a batch with as many columns as there are languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import bucket_of, staged, table

BITS = 18
ORDERS = 4
UNKNOWN = "und"


def presence(text: str, flags: np.ndarray) -> int:
    """Set flags for all 1- to 4-grams of the lower-cased text; returns how many are set."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(points) + 1, np.uint32)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            break
        h = (h[:-1] ^ points[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        flags[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)] = 1
    return int(np.count_nonzero(flags))


def blocks(texts: list[str], columns: np.ndarray | None, size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Presence blocks (0/1, only the given columns) and the texts' norms."""
    flags = np.zeros(1 << BITS, np.uint8)
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        x = np.zeros((len(part), len(columns) if columns is not None else 1 << BITS), np.float32)
        norms = np.zeros(len(part))
        for i, text in enumerate(part):
            norms[i] = presence(text, flags) ** 0.5
            x[i] = flags if columns is None else flags[columns]
            flags[:] = 0
        yield x, norms


@dataclass
class Model:
    langs: list[str]
    columns: np.ndarray
    weights: np.ndarray  # columns x languages: the landmarks' rows times the fitted weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        real = [t if t and any(map(str.isalpha, t)) else None for t in texts]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        at = [i for i, t in enumerate(real) if t is not None]
        done = 0
        for x, norms in blocks([real[i] for i in at], self.columns):
            s = (x @ self.weights) / norms[:, None]
            best = s.argmax(axis=1)
            for i, b, v in zip(at[done:], best, s[np.arange(len(s)), best], strict=False):
                langs[i], scores[i] = self.langs[b], float(min(1.0, max(0.0, (v + 1) / 2)))
            done += len(s)
        return langs, scores


def fit(rows: list[tuple[str, str]], landmarks: int = 200, ridge: float = 0.1) -> Model:
    """rows: (text, lang), in the order in which landmarks are taken, by turns from each language."""
    rows = [(t, c) for t, c in rows if t and any(map(str.isalpha, t))]
    langs = sorted({c for _, c in rows})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    by_lang = [[t for t, c in rows if c == lang] for lang in langs]
    turns = [texts[k] for k in range(max(map(len, by_lang))) for texts in by_lang if k < len(texts)][: max(landmarks, 2 * len(langs))]
    parts = [(x != 0, n) for x, n in blocks(turns, None, 64)]
    seen = np.concatenate([x for x, _ in parts])
    columns = np.flatnonzero(seen.any(axis=0))
    marks = seen[:, columns].astype(np.float32) / np.concatenate([n for _, n in parts])[:, None].astype(np.float32)
    kernel = np.concatenate([(x @ marks.T) / n[:, None] for x, n in blocks([t for t, _ in rows], columns)]).astype(np.float64)
    own = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])  # Nyström features are kernel @ whiten
    phi = kernel @ whiten
    target = np.array([[1.0 if c == lang else -1.0 for lang in langs] for _, c in rows])
    share = (target > 0).mean(axis=0)
    # rows weigh the same for each language in total, so that a rare one is not taken for noise
    each = np.array([1.0 / (len(langs) * share[langs.index(c)]) for _, c in rows])[:, None]
    fitted = np.linalg.solve(phi.T @ (phi * each) + ridge * np.eye(phi.shape[1]), phi.T @ (target * each))
    return Model(langs, columns, (marks.T.astype(np.float64) @ (whiten @ fitted)).astype(np.float32))


def sample(docs: DataFrame, train: Column, per_lang: int, max_rows: int, max_chars: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """About per_lang labelled rows of each language, fewer if that is over max_rows in all: those of the least id hashes."""
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = staged(labelled.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")), "langs")
    per_lang = min(per_lang, max_rows // max(counts.count(), 1))
    unit = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = labelled.where(F.char_length(text_col) <= max_chars).join(counts, F.col(lang_col) == F.col("__lang"))
    rows = rows.where(unit * F.col("__n") <= per_lang).select(unit.alias("u"), F.col(text_col).alias("t"), F.col(lang_col).alias("c")).collect()
    return [(r.t, r.c) for r in sorted(rows)]


def identify(
    docs: DataFrame,
    train: Column,
    per_lang: int = 400,
    max_rows: int = 8000,
    landmarks: int = 200,
    max_chars: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """docs without text_col, plus lang_pred (string) and score (double, 0 to 1).

    Learns from a bounded sample: about per_lang rows of each language, max_rows in all, among those that train
    selects and that have a language and at most max_chars characters. There are `landmarks`, and at least two for
    each language. Predicts every whole text, of any length, from the text alone. `und` with score 0
    where text is null, empty or has no letter, or where there was nothing to learn from. Rows with the same
    text get the same result. Columns named lang_pred or score are replaced. Empty in, empty out.
    """
    model = fit(sample(docs, train, per_lang, max_rows, max_chars, id_col, text_col, lang_col), landmarks)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.columns, model.weights))  # at most 2**18 x languages
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for b in batches:
            langs, scores = fitted.predict(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.select(*rest, text_col).mapInArrow(run, docs.select(*rest).schema.add("lang_pred", "string").add("score", "double"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
