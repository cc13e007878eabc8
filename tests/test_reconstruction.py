"""Reconstruction of crowded places, without Spark."""

from __future__ import annotations

import datetime as dt
import random
import time

import pyarrow as pa
import pytest

from pairwell.operators import reconstruction


def episodes(seed: int, n: int, families: int) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        town = rng.choice(["m1", "m2", None])
        born = None if rng.random() < 0.1 else rng.randrange(80)
        family = rng.choice([None, *(f"f{k}" for k in range(families))])
        out.append({"person_id": f"p{i}", "index_date": dt.date(2020, 1, 1), "exposed": rng.random() < 0.35, "mun": town, "reg": rng.choice(["r1", "r1", None]), "family": family, "born": born, "ord": i})
    return out


def loop(rows: list[dict], ratio: int, caliper: int) -> list[tuple]:
    taken, out = {i: 0 for i, r in enumerate(rows) if r["exposed"]}, []
    for r in rows:
        if r["exposed"]:
            continue
        for at, tier in (("mun", "municipality"), ("reg", "region_fallback")):
            found = []
            for i, n in taken.items():
                x = rows[i]
                gap = None if x["born"] is None or r["born"] is None else abs(x["born"] - r["born"])
                if r[at] is not None and x[at] == r[at] and n < ratio and (x["family"] is None or x["family"] != r["family"]) and not (caliper and gap is not None and gap > caliper):
                    found.append((n, 2**62 if gap is None else gap, x["person_id"], i, gap))
            if found:
                _, _, person, i, gap = min(found)
                taken[i] += 1
                out.append((person, r["person_id"], tier, gap))
                break
    return out


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("caliper", [0, 7])
def test_a_control_finds_the_case_that_a_loop_over_all_finds(seed, caliper):
    rows = episodes(seed, 150, 3)
    got = reconstruction.serve(pa.Table.from_pylist(rows), 2, caliper).to_pylist()
    assert [(r["case_id"], r["control_id"], r["tier"], r["days"]) for r in got] == loop(rows, 2, caliper)


def test_time_does_not_grow_with_the_square_of_a_place():
    """Some 10,000 cases and 20,000 controls of one town: a look at every case took minutes."""
    rows = [{"person_id": f"p{i}", "index_date": dt.date(2020, 1, 1), "exposed": i % 3 == 0, "mun": "m", "reg": "r", "family": None, "born": i * 37 % 2000, "ord": i} for i in range(30_000)]
    start = time.process_time()
    assert reconstruction.serve(pa.Table.from_pylist(rows), 2, 400).num_rows > 19_000
    assert time.process_time() - start < 15
