"""The pipeline's near_dedup stage: which rows are one group."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from corpus_pipeline import near_dedup
from pairwell.llm import near_copies

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def roots(texts):
    """The place of the first text of each text's group, by comparing all that share any shingle."""
    sets, holders, root = [], {}, list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, text in enumerate(texts):
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else {()})
        shared = Counter(j for g in sets[k] for j in holders.get(g, []))
        for j, n in shared.items():
            if 5 * n >= 4 * (len(sets[k]) + len(sets[j]) - n):
                low, high = sorted((find(j), find(k)))
                root[high] = low
        for g in sets[k]:
            holders.setdefault(g, []).append(k)
    return [find(k) for k in range(len(texts))]


def test_near_copies_equal_brute_force(spark):
    rows = sorted(pq.read_table(DOCUMENTS).to_pylist(), key=lambda r: r["doc_id"])
    rng = random.Random(5)
    for k in range(40):  # a large group that hangs together in chains, at 0.7 to 0.95 from its first
        w = [f"w{i}" for i in range(400)]
        for i in rng.sample(range(400), rng.randrange(2, 16)):
            w[i] = f"other{k}x{i}"
        rows.append({"doc_id": 10**6 + k, "text": " ".join(w)})
    root = roots([r["text"] for r in rows])
    want = sorted(rows[k]["doc_id"] for k in set(root))
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(spark, table, "").collect()) == want


def test_similar_sets_share_a_prefix_shingle_in_any_order():
    rng = np.random.default_rng(3)
    for n in [*range(1, 30), 211, 500]:
        pool = np.unique(rng.integers(0, 1 << 62, 2 * n + 8, np.uint64))
        frequent = np.sort(rng.choice(pool, n // 2, replace=False))
        counts = rng.integers(2, 9, len(frequent))
        for _ in range(50):
            x = np.sort(rng.choice(pool, n, replace=False))
            y = np.unique(np.r_[rng.choice(x, n - n // rng.integers(5, 12), replace=False), rng.choice(pool, n // 11, replace=False)])
            if near_copies.similar(x, y):
                assert near_copies.may_be_similar(len(x), len(y), near_copies.parities(x), near_copies.parities(y))
                assert set(near_copies.prefix(x, frequent, counts).tolist()) & set(near_copies.prefix(y, frequent, counts).tolist())


def test_short_parities_reject_no_similar_set():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 64, 65, 300, 1500, 5000):
        sets = [np.unique(rng.integers(0, 1 << 62, n, np.uint64))]
        for _ in range(40):
            gone = rng.integers(0, len(sets[0]) // 6 + 1)
            sets.append(np.unique(np.r_[rng.choice(sets[0], len(sets[0]) - gone, replace=False), rng.integers(0, 1 << 62, rng.integers(0, n // 8 + 1), np.uint64)]))
        sketches = near_copies.Sketches([near_copies.shortened(near_copies.parities(x)) for x in sets], np.array([len(x) for x in sets]))
        for i in range(len(sets)):
            others = np.array([j for j in range(len(sets)) if j != i])
            ok = dict(zip(others.tolist(), sketches.may_be_similar(i, others).tolist(), strict=True))
            assert all(ok[j] for j in others.tolist() if near_copies.similar(sets[i], sets[j]))
    far = [np.unique(rng.integers(0, 1 << 62, 300, np.uint64)) for _ in range(2)]
    assert not near_copies.Sketches([near_copies.shortened(near_copies.parities(x)) for x in far], np.array([300, 300])).may_be_similar(0, np.array([1]))[0]


def test_unrelated_texts_under_null_or_equal_ids_all_stay(spark):
    words = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcdefg"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, words[2]), (5, words[3]), (5, words[4]), (5, words[4]), (6, words[5]), (None, words[5]), (None, None), (None, " ")]
    got = near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text and r.text.strip()) == [(0, words[0]), (0, words[1]), (0, words[2]), (5, words[3]), (5, words[4]), (6, words[5])]
    assert len(got) == 7
