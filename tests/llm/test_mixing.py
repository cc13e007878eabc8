"""Mixing where ids are null."""

from __future__ import annotations

from pairwell.llm.mixing import mix_sources


def test_rows_with_null_ids_draw_each_for_itself(spark):
    rows = [(None, f"text number {k}", "a.example") for k in range(400)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert 320 < len(got) < 480
    assert 200 < len({r.text for r in got}) < 300  # 1 - 1/e of 400 is 253
