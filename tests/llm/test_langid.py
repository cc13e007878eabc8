"""The string-kernel classifier against one built from the definition: sets of n-grams, plain Nyström features, normal equations."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pairwell.llm import langid

SYLLABLES = {"aa": "ka ro mi su te na", "bb": "shto vre gdy pla noi ko", "cc": "ung eich st er ver ge"}


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        mixed = [rng.choice(SYLLABLES[lang if rng.random() < 0.8 else rng.choice(sorted(SYLLABLES))].split()) for _ in range(rng.randrange(5, 40))]
        out.append(("".join(w + rng.choice(["", " "]) for w in mixed), lang))
    return out


def grams(text):
    return {text.lower()[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}


def kernel(x, y):
    return np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in y] for a in x])


def scores(train, test, landmarks, ridge):
    langs = sorted({c for _, c in train})
    by_lang = [[t for t, c in train if c == lang] for lang in langs]
    marks = [grams(ts[k]) for k in range(len(train)) for ts in by_lang if k < len(ts)][:landmarks]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel([grams(t) for t, _ in train], marks) @ root
    out = []
    for lang in langs:
        y = np.array([1.0 if c == lang else -1.0 for _, c in train])
        weight = np.array([1 / (len(langs) * sum(d == c for _, d in train) / len(train)) for _, c in train])
        beta = np.linalg.solve(phi.T @ (weight[:, None] * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (weight * y))
        out.append(kernel([grams(t) for t in test], marks) @ root @ beta)
    return langs, np.array(out).T


@pytest.mark.parametrize("landmarks", [12, 200])
def test_predictions_equal_the_definition(monkeypatch, landmarks):
    monkeypatch.setattr(langid, "BITS", 21)  # so that hardly any two n-grams share a feature
    train, test = texts(1, 60), [t for t, _ in texts(2, 80)]
    langs, want = scores(train, test, landmarks, 0.1)
    got, score = langid.fit(train, landmarks).predict(test)
    assert got == [langs[k] for k in want.argmax(axis=1)]
    assert score == pytest.approx(np.clip((want.max(axis=1) + 1) / 2, 0, 1).tolist(), abs=2e-3)


def test_the_query_predicts_as_the_fitted_model(spark):
    rows = texts(3, 90)
    table = spark.createDataFrame([(i, t, c, i % 3 == 0) for i, (t, c) in enumerate(rows)], "doc_id long, text string, lang string, held boolean")
    got = {r.doc_id: r.lang_pred for r in langid.identify(table, ~table["held"]).collect()}
    learned = langid.sample(table, ~table["held"], 400, 8000, 50_000, "doc_id", "text", "lang")
    assert sorted(learned) == sorted((t, c) for i, (t, c) in enumerate(rows) if i % 3)
    assert [got[i] for i in range(90)] == langid.fit(learned).predict([t for t, _ in rows])[0]
    few = langid.sample(table, ~table["held"], 400, 12, 50_000, "doc_id", "text", "lang")
    assert 0 < len(few) < 40
