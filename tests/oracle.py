"""Runs a registered query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(records: list[dict]) -> list[tuple]:
    return sorted((tuple(plain(r[k]) for k in sorted(r)) for r in records), key=lambda t: [(x is None, str(x)) for x in t])


def sql_rows(sql: str, sf: str) -> list[tuple]:
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows([dict(zip(names, r, strict=True)) for r in cur.fetchall()])


def spark_rows(df) -> list[tuple]:
    return rows([r.asDict(recursive=True) for r in df.collect()])
