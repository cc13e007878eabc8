"""Registered queries against their SQL or a brute-force version over the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import oracle
import pyarrow.parquet as pq
import pytest
import xxhash

from pairwell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.spark_rows(QUERIES[name](spark, SF)) == oracle.sql_rows(ORACLE_SQL[name], "sf0.001")


def test_suffix_dedup_equals_brute_force(spark, docs):
    raw = {d: t.encode() for d, t in docs.items()}
    seen = Counter(hash(b[i : i + 400]) for b in raw.values() for i in range(len(b) - 399))
    got = rows(spark, "op8_suffix_dedup")
    assert got.keys() == raw.keys()
    for d, b in raw.items():
        gone, reach, spans = bytearray(len(b)), 0, 0
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                spans += i > reach or not any(gone)
                gone[max(i, reach) : i + 400] = b"\1" * (i + 400 - max(i, reach))
                reach = i + 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_simhash_equals_brute_force(spark, docs):
    def fingerprint(text):
        w = WORD.findall(text.translate(LOWER))
        grams = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    prints = {d: fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = rows(spark, "op10_golay_simhash")
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", find(d)) for d in prints}


def test_hidden_markov_base_columns_equal_brute_force(spark, docs):
    tokens = {d: WORD.findall(t.translate(LOWER)) + [None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = rows(spark, "op2_hidden_markov")
    assert got.keys() == docs.keys()
    for d, ws in tokens.items():
        r = got[d]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_language_is_right_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = [r for r in rows(spark, "op4_string_kernels").values() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.9 * len(got)
