"""Reconstruction of case-control pairs from episodes: controls choose cases, by municipality and else by region."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.sources.staging import forget, written

MUNICIPALITY, REGION = "municipality", "region_fallback"


@dataclass(frozen=True)
class ReconstructionOptions:
    """max_ratio: controls per case, at least 1. caliper_days: largest difference of birth dates; 0 or less: none."""

    max_ratio: int = 1
    caliper_days: int = 0


@dataclass(frozen=True)
class Reconstruction:
    """pairs(case_id, control_id, index_date, tier, days), and the ids of eligible cases."""

    pairs: DataFrame
    eligible: DataFrame

    def ids(self) -> DataFrame:
        """(kind, id): eligible_case, and case and control ids matched at all and by tier."""
        tiers = {"matched": F.lit(True), MUNICIPALITY: F.col("tier") == MUNICIPALITY, "region": F.col("tier") == REGION}
        out = self.eligible.select(F.lit("eligible_case").alias("kind"), F.col("person_id").alias("id"))
        for name, which in tiers.items():
            for side in ("case", "control"):
                out = out.unionByName(self.pairs.where(which).select(F.lit(f"{name}_{side}").alias("kind"), F.col(f"{side}_id").alias("id")))
        return out.distinct()


def normal(c: str) -> Column:
    """A trimmed value; blank is null."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def _linked(rows: DataFrame) -> DataFrame:
    """rows with part: places that municipalities and regions link within a date and sex, by their least name.

    Controls only ever look at cases of their municipality or region, so parts are independent. The table of
    distinct places is small; names are handed on between the two sides until none changes.
    """
    keys = ["index_date", "sex_key"]
    own = F.coalesce(F.concat(F.lit("r"), F.col("reg")), F.concat(F.lit("m"), F.col("mun")), F.lit(""))
    places = written(rows.select(*keys, "mun", "reg", own.alias("part")).distinct(), "places")
    while True:
        low = places
        for side in ("mun", "reg"):
            least = F.min("part").over(Window.partitionBy(*keys, side))
            low = low.withColumn("part", F.when(F.col(side).isNull(), F.col("part")).otherwise(least))
        after = written(low, "places")
        changed = after.agg(F.sum(F.xxhash64("part") % 1000003)).first()[0] != places.agg(F.sum(F.xxhash64("part") % 1000003)).first()[0]
        forget(places)
        places = after
        if not changed:
            break
    named = places.select(*[F.col(c).alias(f"__{c}") for c in (*keys, "mun", "reg")], "part")
    same = F.lit(True)
    for c in (*keys, "mun", "reg"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(named, same).select(*rows.columns, "part")


class _Open:
    """Cases of one place that have one number of controls, by birth date and name, and those without a birth date by name."""

    def __init__(self, named: bool):
        self.dated: list[tuple[int, int]] = []
        self.undated: list[int] = []
        self.all: list[int] | None = [] if named else None

    def add(self, name: int, born: int | None) -> None:
        if born is None:
            insort(self.undated, name)
        else:
            insort(self.dated, (born, name))
        if self.all is not None:
            insort(self.all, name)

    def remove(self, name: int, born: int | None) -> None:
        if born is None:
            del self.undated[bisect_left(self.undated, name)]
        else:
            del self.dated[bisect_left(self.dated, (born, name))]
        if self.all is not None:
            del self.all[bisect_left(self.all, name)]

    def first(self, born: int | None, caliper: int, allowed: Callable[[int], bool]) -> int | None:
        """The nearest birth date, then the least name, of those that are allowed; unknown differences come last."""
        if born is None:
            return next(filter(allowed, self.all), None)
        rows = self.dated
        up = bisect_left(rows, (born, -1))
        down = up - 1
        while up < len(rows) or down >= 0:
            above = rows[up][0] - born if up < len(rows) else None
            below = born - rows[down][0] if down >= 0 else None
            gap = min(x for x in (above, below) if x is not None)
            if caliper and gap > caliper:
                break
            found = []
            if above == gap:
                day = rows[up][0]
                while up < len(rows) and rows[up][0] == day:
                    if allowed(rows[up][1]):
                        found.append(rows[up][1])
                        up = bisect_left(rows, (day + 1, -1), up)
                        break
                    up += 1
            if below == gap:
                day = rows[down][0]
                start = at = bisect_left(rows, (day, -1), 0, down + 1)
                while at <= down:
                    if allowed(rows[at][1]):
                        found.append(rows[at][1])
                        break
                    at += 1
                down = start - 1
            if found:
                return min(found)
        return next(filter(allowed, self.undated), None)


def serve(table: pa.Table, ratio: int, caliper: int) -> pa.Table:
    """The pairs of one task's rows. Cases are kept sorted, by place and number of controls, so that a control finds
    its case without a look at the others."""
    table = table.sort_by([("ord", "ascending"), ("person_id", "ascending")])
    person, family, born, exposed, date = (table.column(c).to_pylist() for c in ("person_id", "family", "born", "exposed", "index_date"))
    places = {kind: table.column(kind).to_pylist() for kind in ("mun", "reg")}
    cases = [i for i, x in enumerate(exposed) if x]
    named = any(b is None and not x for b, x in zip(born, exposed, strict=True))
    by_name = sorted(cases, key=lambda i: (person[i] is not None, person[i] or "", i))
    name = dict(zip(by_name, range(len(by_name)), strict=True))
    of = {(kind, p): [_Open(named) for _ in range(ratio)] for kind in places for p in {places[kind][i] for i in cases} - {None}}
    for i in by_name:  # in order of names, so that each is put at the end of those of its date
        for kind in places:
            if places[kind][i] is not None:
                of[kind, places[kind][i]][0].add(name[i], born[i])
    controls = [0] * len(by_name)
    out: list[tuple] = []
    for i in range(len(person)):
        if exposed[i]:
            continue
        who, kin = person[i], family[i]

        def allowed(n: int) -> bool:
            case = by_name[n]
            return person[case] != who and (kin is None or family[case] != kin)

        got = None
        for kind, tier in (("mun", MUNICIPALITY), ("reg", REGION)):
            for open_ in of.get((kind, places[kind][i]), ()):
                got = open_.first(born[i], caliper, allowed)
                if got is not None:
                    break
            if got is not None:
                break
        if got is None:
            continue
        case = by_name[got]
        for k in places:
            levels = of.get((k, places[k][case]))
            if levels:
                levels[controls[got]].remove(got, born[case])
                if controls[got] + 1 < ratio:
                    levels[controls[got] + 1].add(got, born[case])
        controls[got] += 1
        days = None if born[case] is None or born[i] is None else abs(born[case] - born[i])
        out.append((person[case], who, date[case], tier, days))
    cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
    kinds = (pa.string(), pa.string(), pa.date32(), pa.string(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["case_id", "control_id", "index_date", "tier", "days"])


def reconstruct_pairs(episodes: DataFrame, options: ReconstructionOptions = ReconstructionOptions(), order: str = "ord") -> Reconstruction:
    """episodes(person_id, index_date, exposed, sex, municipality, region, family_id, birth_date, <order>).

    In order, each control row takes the case of its date, sex and municipality, else region, that has the
    fewest controls, then the nearest birth date, then the least id; not itself, not its family, not beyond the
    caliper. Missing sexes are one group, missing birth dates pass, blank places and families are missing. Of
    several exposed rows of a person and date the first is the case. The choice depends on all before it, so a
    task serves one part of one date and sex in order.
    """
    ratio, caliper = max(options.max_ratio, 1), max(options.caliper_days, 0)
    rows = episodes.select(
        F.col("person_id").cast("string").alias("person_id"), F.to_date("index_date").alias("index_date"), F.coalesce("exposed", F.lit(False)).alias("exposed"),
        F.coalesce(F.col("sex").cast("int"), F.lit(-1)).alias("sex_key"), normal("municipality").alias("mun"), normal("region").alias("reg"), normal("family_id").alias("family"),
        F.unix_date(F.to_date("birth_date")).alias("born"), F.col(order).alias("ord"),
    )
    first = F.row_number().over(Window.partitionBy("person_id", "index_date").orderBy("ord"))
    cases = rows.where("exposed").withColumn("__n", first).where("__n = 1").drop("__n")
    wanted = _linked(cases.unionByName(rows.where("not exposed")))

    def run(table: pa.Table) -> pa.Table:
        return serve(table, ratio, caliper)

    got = wanted.groupBy("index_date", "sex_key", "part").applyInArrow(run, "case_id string, control_id string, index_date date, tier string, days long")
    return Reconstruction(written(got, "reconstructed"), cases.select("person_id").distinct())
