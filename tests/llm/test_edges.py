"""Every operator and stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwell.llm.chat import digests, format_conversations
from pairwell.llm.common import bucket_of
from pairwell.llm.decontam import drop_leaks, mark_leaks
from pairwell.llm.hmm import score_documents
from pairwell.llm.host_rules import judge_documents, keep_good
from pairwell.llm.langid import identify
from pairwell.llm.line_dedup import drop_shared_lines
from pairwell.llm.mixing import mix_sources
from pairwell.llm.simhash import drop_near_duplicates, near_duplicates
from pairwell.llm.suffix_dedup import remove_repeats
from pairwell.llm.token_counts import length_sums

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "key n words doc h1 item id t z fp cell copy hits start c0 n_words n_tokens score held_out component_id order_key".split()
LINE = "This line is shared by many documents and has over forty characters."
LONG = " ".join(f"word{i % 5003}x{i // 7}" for i in range(120_000))


def awkward():
    shared = [(k, f"{LINE}\nown words of document number {k}", "en", "a.example", 1) for k in range(10, 16)]
    return [
        (1, None, "en", "a.example", None),
        (2, "", None, None, 0),
        (3, " \t\n\r\n ", "en", "b.example", 6),
        (None, "no id here but some words", "en", "a.example", 25),
        (None, None, None, None, None),
        (4, LONG, "en", "b.example", len(LONG)),
        (5, "the same row twice over", "fr", "a.example", 23),
        (5, "the same row twice over", "fr", "a.example", 23),
        (6, "x" * 100_000, "de", "c.example", 100_000),
        (7, "Ünïcödé \U0001f600 текст 文字列", None, "c.example", 20),
        *shared,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(awkward(), DDL)
    return plain.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}x{i // 7}" for i in range(20))), (2, None), (None, "short item"), (3, "")], "item_id long, text string")


def test_token_counts(docs, none):
    got = length_sums(docs).collect()
    assert sum(r.n_docs for r in got) == len(awkward())
    assert next(r for r in got if r.n_tokens == 0).n_docs == 3
    assert length_sums(none).collect() == []


def test_hidden_markov(docs, none):
    got = score_documents(docs, bucket_of(F.col("doc_id"), 7) == 2).collect()
    assert len(got) == len(awkward())
    assert all(r.score <= 0 and r.base_score <= 0 and r.n_tokens >= 1 and r.key == "extra key" for r in got)
    assert score_documents(none, F.lit(False)).collect() == []
    untrained = score_documents(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)}


def test_mixing(docs, none):
    got = mix_sources(docs, size=3.0).collect()
    assert all(1 <= r.copy and 0 <= r.order_key < 1 for r in got)
    assert {r.source for r in got} <= {None, "a.example", "b.example", "c.example"}
    assert mix_sources(none).collect() == []
    assert mix_sources(docs, weights={"nowhere": 1.0}).collect() == []


def test_language(docs, none):
    got = identify(docs, F.lit(True)).collect()
    assert len(got) == len(awkward())
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3))
    assert identify(none, F.lit(True)).collect() == []
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}


def test_host_rules(docs, none):
    got = judge_documents(docs).collect()
    assert len(got) == len(awkward())
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert {r.doc_id for r in keep_good(docs).collect()} == {r.doc_id for r in got if r.kept} == {4}
    assert judge_documents(none).collect() == [] == keep_good(none).collect()


def test_line_dedup(docs, none):
    got = drop_shared_lines(docs).collect()
    assert len(got) == len(awkward())
    assert {r.doc_id for r in got if r.n_dropped} == set(range(10, 15))
    assert sum(r.text.count(LINE) for r in got) == 1
    assert drop_shared_lines(none).collect() == []


def test_chat(spark):
    ddl = "conv_id long, turn int, role string, text string, formatted string"
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", "\\n### </turn>\n", "x"), (1, 2, "assistant", "", "x"), (None, None, None, None, "x"), (2, 0, "a\n### b", "y" * 300_000, "x")]
    got = {r.conv_id: r for r in digests(format_conversations(spark.createDataFrame(rows, ddl))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 14), None: (1, 0), 2: (1, 0)}
    assert digests(format_conversations(spark.createDataFrame([], ddl))).collect() == []


@pytest.mark.parametrize("keep", ["first", "none"])
def test_suffix_dedup(docs, none, keep):
    got = remove_repeats(docs, keep=keep).collect()
    assert len(got) == len(awkward())
    assert all(len(r.text) + r.n_removed == r.n_bytes for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].n_removed == (100_000 if keep == "none" else 99_999)
    assert by_id[4].n_removed == by_id[2].n_bytes == 0
    assert remove_repeats(none).collect() == []


def test_decontamination(docs, none, bench):
    got = mark_leaks(docs, bench).collect()
    assert len(got) == len(awkward())
    assert {(r.doc_id, r.n_hit, r.n_items) for r in got if r.n_hit} == {(4, 20, 1)}
    assert drop_leaks(docs, bench).count() == len(awkward())  # 20 of 120,000 words
    assert {r.doc_id for r in drop_leaks(docs, docs.select(F.lit(9).cast("long").alias("item_id"), "text")).collect()} == {1, 2, 3, None}
    assert mark_leaks(none, bench).collect() == [] == drop_leaks(none, bench).collect()
    assert mark_leaks(docs, bench.where("false")).where("n_hit > 0").collect() == []


def test_simhash(docs, none):
    got = near_duplicates(docs).collect()
    assert len(got) == len(awkward())
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert near_duplicates(none).collect() == []
    kept = [r.doc_id for r in drop_near_duplicates(docs).collect()]
    assert kept.count(5) == 1 and 1 in kept and 2 not in kept and 3 not in kept
    assert drop_near_duplicates(none).collect() == []


def test_stages(spark, docs, none):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs.drop("copy", "order_key", "n_words", "n_tokens", "fp", "component_id"), none):
            out = stage(spark, table, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns, name
            assert out.count() <= 3 * table.count(), name
