"""Hosts whose shrunk failure rate lies far outside of the others' go, small ones are spared."""

from __future__ import annotations

import pytest

from pairwell.llm import host_rules

CLEAN = " ".join(f"word{i}" for i in range(80))
DDL = "doc_id long, source string, text string"


def rows():
    out = []
    for k in range(20):  # ordinary hosts, of which a tenth of the documents fail
        out += [(f"host{k}", CLEAN if i % 10 else "too short") for i in range(50)]
    out += [("junk", CLEAN if i == 7 else "too short") for i in range(60)]
    out += [("small", CLEAN), ("small", "too short"), ("small", "too short")]
    out += [(None, CLEAN if i == 3 else "too short") for i in range(40)]
    out += [("listing", "\n".join([CLEAN, "again", *["again"] * 30])) for _ in range(45)]
    return [(i, s, t) for i, (s, t) in enumerate(out)]


def test_a_junk_host_goes_with_its_clean_documents(spark):
    table = spark.createDataFrame(rows(), DDL)
    got = {r.doc_id: r for r in host_rules.judge_documents(table).collect()}
    by_host = {}
    for i, s, t in rows():
        by_host.setdefault(s, []).append((t, got[i]))
    assert {s for s, rs in by_host.items() if rs[0][1].host_rejected} == {"junk", None, "listing"}
    junk = next(r for t, r in by_host["junk"] if t == CLEAN)
    assert (junk.base_failed, junk.kept) == (False, False)
    assert [r.kept for _, r in by_host["small"]] == [True, False, False]
    assert all(r.kept == (t == CLEAN) for s, rs in by_host.items() if s and s.startswith("host") for t, r in rs)
    assert {r.doc_id for r in host_rules.keep_good(table).collect()} == {i for i, r in got.items() if r.kept}


def test_hosts_that_differ_by_chance_alone_all_stay(spark):
    table = spark.createDataFrame([(i, f"host{i % 4}", CLEAN if i % 8 < 4 else "too short") for i in range(400)], DDL)
    assert not any(r.host_rejected for r in host_rules.judge_documents(table).collect())


@pytest.mark.parametrize("rejecting", [True, False])
def test_verdicts_follow_the_prior(spark, rejecting):
    table = spark.createDataFrame([(i, "a" if i % 2 else "b", CLEAN if i % 2 == 0 or not rejecting else "no") for i in range(60)], DDL)
    # of two hosts, half of all fail: the prior is so wide that neither lies outside
    assert not any(r.host_rejected for r in host_rules.judge_documents(table).collect())
