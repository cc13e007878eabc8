"""Every registered query of the cohort operators against its SQL."""

from __future__ import annotations

import oracle
import pytest

from pairwell import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = oracle.spark_rows(q.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert got == oracle.sql_rows(q.ORACLE_SQL[name], "sf0.001")
    assert got


def test_only_reconstruction_has_no_sql():
    assert set(q.QUERIES) - set(q.ORACLE_SQL) == {"reconstruction"}
