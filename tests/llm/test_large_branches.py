"""The ways that only large data take, with their limits lowered, against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from pairwell.llm import decontam, near_copies, simhash, suffix_dedup
from pairwell.llm.components import components


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def crowded_prints():
    rng = np.random.default_rng(21)
    out = set()
    for centre in rng.integers(0, 1 << 63, 6).tolist():  # clouds of fingerprints that are nearly alike
        for _ in range(50):
            x = centre
            for bit in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << bit
            out.add(x)
    return sorted(out | set(rng.integers(0, 1 << 63, 30).tolist()))


@pytest.mark.parametrize(("block", "cells"), [(8, 1 << 14), (2, 64), (1, 7)])
def test_crowded_golay_keys_lose_no_link(spark, monkeypatch, block, cells):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CELLS", cells)
    prints = crowded_prints()
    root = {x: x for x in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            low, high = sorted((find(root, a), find(root, b)))
            root[high] = low
    table = spark.createDataFrame([(x,) for x in np.array(prints, np.uint64).view(np.int64).tolist()], "fp long")
    got = {x: x for x in prints}
    for r in simhash.link_forest(table).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        low, high = sorted((find(got, a), find(got, b)))
        got[high] = low
    assert {x: find(got, x) for x in prints} == {x: find(root, x) for x in prints}


def test_longer_keys_are_shared_within_four_bits():
    tables, rng = simhash.golay_tables(), np.random.default_rng(22)
    for _ in range(300):
        x = y = int(rng.integers(0, 1 << 63))
        for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
            y ^= 1 << bit
        both = np.array([x, y], np.uint64).view(np.int64)
        keys, rows = simhash.pair_keys(both, tables)
        long, at = simhash.longer_keys(keys, both[rows], tables)
        owner = rows[at]
        assert set(long[owner == 0].tolist()) & set(long[owner == 1].tolist())


def passages():
    rng = random.Random(23)
    shared = ["".join(rng.choices("abcdefgh ", k=700)) for _ in range(3)]
    out = {}
    for k in range(14):
        out[k] = "".join(rng.choices("ABCDEFGH ", k=150)) + shared[k % 3][rng.randrange(200) :] + "".join(rng.choices("xyz", k=90))
    return out | {20: out[1], 21: "q" * 900}


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("group", "carried"), [(2, 10**6), (2, 0), (10**6, 0)])
def test_crowded_anchors_lose_no_repeat(spark, monkeypatch, keep, group, carried):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "CARRIED", carried)
    texts = passages()
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep=keep).collect()}
    places = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - 399):
            places.setdefault(texts[k][i : i + 400], []).append((k, i))
    for k, text in texts.items():
        gone = bytearray(len(text))
        for i in range(len(text) - 399):
            at = places[text[i : i + 400]]
            if len(at) > 1 and (keep == "none" or at[0] != (k, i)):
                gone[i : i + 400] = b"\1" * 400
        assert bytes(got[k].text) == "".join(c for c, g in zip(text, gone, strict=True) if not g).encode()


def test_texts_under_one_id_keep_their_own_spans(spark):
    texts = list(passages().values())
    table = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    apart = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lengths = lambda df: sorted(r.n_removed for r in suffix_dedup.remove_repeats(df, keep="none").collect())
    assert lengths(table) == lengths(apart)


def test_joined_windows_equal_carried_ones(spark, monkeypatch):
    rng = random.Random(24)
    words = lambda n: " ".join(rng.choice("one two three four five six seven".split()) + str(rng.randrange(40)) for _ in range(n))
    items = [words(30) for _ in range(5)] + ["a short item"]
    docs = [words(20) + " " + items[k % 6] + " " + words(15) for k in range(12)] + [words(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    usual = {r.doc_id: (r.n_hit, tuple(r["items"])) for r in decontam.mark_leaks(table, bench).collect()}
    assert sum(n > 0 for n, _ in usual.values()) == 12
    monkeypatch.setattr(decontam, "CARRIED", 0)
    assert {r.doc_id: (r.n_hit, tuple(r["items"])) for r in decontam.mark_leaks(table, bench).collect()} == usual


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 if i <= 30 else 31 for i in range(61) if i not in (0, 31)}


def test_turns_change_no_group(spark, monkeypatch):
    rng = random.Random(25)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(20):
            w = list(base)
            for i in rng.sample(range(120), rng.randrange(0, 5)):
                w[i] = f"x{rng.random()}"
            rows.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = []
    for turns in (1, 3):
        monkeypatch.setattr(near_copies, "TURNS", turns)
        kept.append(sorted(r.doc_id for r in near_copies.drop_near_copies(table).collect()))
    assert kept[0] == kept[1]
