"""Greedy matching without replacement, in parallel.

The serial pass (anchors in their order, each taking the best that is left) equals deferred acceptance where
every resource keeps the earliest anchor that asks for it. Deferred acceptance may ask in any order, and what
a resource has once refused stays refused. So:

- Only the best few edges of each anchor are listed. An anchor whose list runs out gets its next edges later,
  and of these only the ones that no earlier anchor holds.
- Lists are dealt into blocks of bounded size by stratum and date. Within a block, a pass in the anchors' order
  settles everything; where two blocks hold the same resource, the later anchor loses it and its block is
  passed again, until no two blocks disagree.

Neither the edges of a stratum nor its anchors are ever gathered in one task. Fallback ratios ("three or none")
are not substitutable, so the above does not hold for them: serial_pass takes the anchors in blocks, in order.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.plans.spec import RatioPolicy
from pairwell.sources.staging import forget, written

#: Edges listed for each anchor at first, as a multiple of the ratio (and at least), and by how much lists then grow.
LISTED = 4
LISTED_LEAST = 8
GROWTH = 8
#: Listed edges of a block.
BLOCK = 100_000
#: Listed edges of blocks that are passed as one where they disagree.
TOGETHER = 1_000_000
#: Anchors that the serial pass takes at once.
TURN = 20_000

TAKEN = ["grp", "a_ord", "a_id", "c_id", "c_unique", "days", "distance"]
ANCHOR = ["grp", "a_ord", "a_id"]


def best(edges: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The best edges of every anchor, with their rank; Spark keeps only that many per anchor before it shuffles."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(*ANCHOR).orderBy(*order))).where(F.col("rank") <= count)


def chosen(edges: DataFrame, policy: RatioPolicy, order: list[Column]) -> DataFrame:
    """What every anchor takes by itself, as with replacement."""
    if not policy.strict:
        return best(edges, order, policy.steps[0]).select(*TAKEN)
    ranked = best(edges, order, policy.steps[0])
    n = F.count(F.lit(1)).over(Window.partitionBy(*ANCHOR))
    target = F.coalesce(*[F.when(n >= s, F.lit(s)) for s in policy.steps], F.lit(0))
    return ranked.withColumn("take", target).where("rank <= take").select(*TAKEN)


def _served(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The table in the order in which the serial pass reads it (nulls first, as in Spark), and where each anchor starts."""
    order = [("a_ord", "ascending"), ("a_id", "ascending"), ("rank", "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start")).combine_chunks()
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        same = np.ones(table.num_rows - 1, bool)
        for name in ("a_ord", "a_id"):
            x, y = table.column(name)[1:], table.column(name)[:-1]
            both_null = pc.and_(pc.is_null(x), pc.is_null(y))
            same &= pc.if_else(both_null, True, pc.fill_null(pc.equal(x, y), False)).to_numpy(zero_copy_only=False).astype(bool)
        new[1:] = ~same
    return table, np.r_[np.flatnonzero(new), table.num_rows]


def _numbered(resources: pa.ChunkedArray) -> list[int]:
    """A number for each resource, -1 for none."""
    codes = pc.index_in(resources, pc.drop_null(pc.unique(resources)))
    return pc.fill_null(codes, -1).to_pylist()


def _key(o: object, i: object) -> tuple:
    return (o is not None, o), (i is not None, i)


def settle(lists: pa.Table, limits: pa.Table | None, ratio: int) -> pa.Table:
    """The pass over one block: the listed edges that are taken, and the end of each list that ran out.

    limits(resource, h_ord, h_id): an anchor in another block has the resource, so later ones cannot.
    """
    lists, starts = _served(lists)
    firsts = lists.select(["a_ord", "a_id"]).take(pa.array(starts[:-1]))
    codes = _numbered(lists.column("resource"))
    more = lists.column("more").to_pylist()
    before: dict[int, int] = {}  # the first anchor that may not have the resource
    if limits is not None and limits.num_rows:
        keys = [_key(*x) for x in zip(firsts.column("a_ord").to_pylist(), firsts.column("a_id").to_pylist(), strict=True)]
        number = dict(zip(lists.column("resource").to_pylist(), codes, strict=True))
        for r, o, i in zip(*(limits.column(c).to_pylist() for c in ("resource", "h_ord", "h_id")), strict=True):
            if r in number:
                before[number[r]] = min(bisect_right(keys, _key(o, i)), before.get(number[r], len(keys)))
    holder = [-1] * (max(codes, default=-1) + 1)
    take, out_of = [], []
    bounds = starts.tolist()
    for me in range(len(bounds) - 1):
        got = 0
        for i in range(bounds[me], bounds[me + 1]):
            r = codes[i]
            if r >= 0:
                if (holder[r] >= 0 and holder[r] != me) or (before and me >= before.get(r, me + 1)):
                    continue
                holder[r] = me
            take.append(i)
            got += 1
            if got == ratio:
                break
        if got < ratio and more[bounds[me + 1] - 1]:
            out_of.append(bounds[me + 1] - 1)
    out = lists.select(["blk", *TAKEN, "resource"]).take(pa.array(take + out_of, pa.int64()))
    return out.append_column("out_of_list", pa.array([False] * len(take) + [True] * len(out_of), pa.bool_()))


def _blocks(lists: DataFrame) -> DataFrame:
    """lists with blk: ranges of strata and dates that hold some BLOCK rows each."""
    count = lists.count()
    parts = -(-count // BLOCK)
    if parts <= 1:
        return lists.withColumn("blk", F.lit(0))
    place = lists.select(*ANCHOR, "a_day").distinct().repartitionByRange(parts, "grp", "a_day", "a_ord", "a_id")
    place = written(place.select(*[F.col(c).alias(f"__{c}") for c in ANCHOR], F.spark_partition_id().alias("blk")), "blocks")
    same = F.lit(True)
    for c in ANCHOR:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return lists.join(place, same).select(*lists.columns, "blk")


def _pass(lists: DataFrame, limits: DataFrame | None, ratio: int, together: bool = False) -> DataFrame:
    """Each block passed by itself, or all of lists as one."""
    types = dict(lists.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in ["blk", *TAKEN, "resource"]) + ", out_of_list boolean"
    by = lambda df: df.withColumn("task", F.lit(0) if together else F.col("blk")).groupBy("task")
    if limits is None:
        return by(lists).applyInArrow(lambda x: settle(x, None, ratio), schema)
    return by(lists).cogroup(by(limits)).applyInArrow(lambda x, y: settle(x, y, ratio), schema)


def _agreed(lists: DataFrame, held: DataFrame, limits: DataFrame | None, ratio: int) -> tuple[DataFrame, DataFrame | None]:
    """held, the passes over blocks, made to agree on every resource; and the limits that this took.

    Blocks that disagree are passed again with what they lost as limits. Once they are few, they are passed as one.
    """
    while True:
        rivals = held.where("resource is not null and not out_of_list").groupBy("resource")
        rivals = rivals.agg(F.min(F.struct("a_ord", "a_id")).alias("first"), F.min("blk").alias("low"), F.max("blk").alias("high"))
        won = written(rivals.where("low < high").select("resource", F.col("first.a_ord").alias("h_ord"), F.col("first.a_id").alias("h_id")), "won")
        if won.isEmpty():
            forget(won)
            return held, limits
        new = lists.select("blk", "resource").distinct().join(won, "resource").select("blk", "resource", "h_ord", "h_id")
        least = (new if limits is None else limits.unionByName(new)).groupBy("blk", "resource").agg(F.min(F.struct("h_ord", "h_id")).alias("first"))
        limits = written(least.select("blk", "resource", "first.*"), "limits")
        asked = held.where("not out_of_list").join(won, "resource")
        involved = written(asked.groupBy("blk").agg(F.max(F.struct("h_ord", "h_id") < F.struct("a_ord", "a_id")).alias("lost")), "involved")  # blocks, not rows
        together = lists.join(involved, "blk", "left_semi").limit(TOGETHER + 1).count() <= TOGETHER
        some = involved if together else involved.where("lost")
        again = _pass(lists.join(some, "blk", "left_semi"), limits.join(some, "blk", "left_semi"), ratio, together)
        after = written(held.join(some, "blk", "left_anti").unionByName(again), "held")
        forget(held, involved, won)
        held = after


def deferred_acceptance(edges: DataFrame, policy: RatioPolicy, order: list[Column]) -> DataFrame:
    """edges(grp, a_day, a_ord, a_id, c_id, c_unique, resource, days, ...) cut to what the serial pass would take.

    A null resource is never used up.
    """
    ratio = policy.steps[0]
    size = max(LISTED_LEAST, LISTED * ratio)
    columns = [*TAKEN, "a_day", "resource", "rank", "more"]

    def listed(some: DataFrame, size: int, after: int) -> DataFrame:
        top = best(some, order, size + 1)
        more = F.max("rank").over(Window.partitionBy(*ANCHOR)) > size
        return top.withColumn("more", more).where(F.col("rank") <= size).withColumn("rank", F.col("rank") + after).select(*columns)

    first = written(listed(edges, size, 0), "listed")
    lists = written(_blocks(first), "lists")
    forget(first)
    held, limits = _agreed(lists, written(_pass(lists, None, ratio), "held"), None, ratio)
    after = size
    while True:
        short = written(held.where("out_of_list").select("blk", *ANCHOR), "short")
        if short.isEmpty():
            return held.where("not out_of_list").select(*TAKEN)
        size *= GROWTH
        holders = held.where("resource is not null and not out_of_list").groupBy("resource").agg(F.min(F.struct("a_ord", "a_id")).alias("holder"))
        known = lists.join(short.select("a_ord", "a_id"), ["a_ord", "a_id"], "left_semi").select("a_ord", "a_id", "c_id")
        open_ = edges.join(short.select("a_ord", "a_id"), ["a_ord", "a_id"], "left_semi").join(holders, "resource", "left")
        open_ = open_.where(F.col("holder").isNull() | (F.col("holder") >= F.struct("a_ord", "a_id"))).drop("holder")
        open_ = open_.join(known, ["a_ord", "a_id", "c_id"], "left_anti")
        new = written(listed(open_, size, after).join(short.select("blk", "a_ord", "a_id"), ["a_ord", "a_id"]), "listed")
        after += size
        # of the old lists, what an earlier anchor has is refused for good, and no mark of a list that ran out is left
        old = lists.join(holders, "resource", "left").where(F.col("holder").isNull() | (F.col("holder") >= F.struct("a_ord", "a_id")))
        old = old.drop("holder").join(short.select("a_ord", "a_id", F.lit(True).alias("hit")), ["a_ord", "a_id"], "left")
        old = old.withColumn("more", F.col("more") & F.col("hit").isNull()).select(*lists.columns)
        grown = written(old.unionByName(new), "lists")
        touched = written(short.select("blk").distinct(), "touched")
        again = _pass(grown.join(touched, "blk", "left_semi"), None if limits is None else limits.join(touched, "blk", "left_semi"), ratio)
        fresh = written(held.join(touched, "blk", "left_anti").unionByName(again), "held")
        forget(lists, held, short, touched, new)
        lists = grown
        held, limits = _agreed(lists, fresh, limits, ratio)


def serial_pass(edges: DataFrame, anchors: DataFrame, policy: RatioPolicy, order: list[Column], together: bool = False) -> DataFrame:
    """The serial pass itself, for fallback ratios: blocks of anchors in their order, strata side by side.

    anchors(a_ord, a_id) are cut into turns of TURN; each turn sees only what earlier turns left, and a task has
    one turn's edges of one stratum, or of all strata together if resources are shared between strata.
    """
    types = dict(edges.dtypes)
    columns = [*TAKEN, "resource"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)

    def run(table: pa.Table) -> pa.Table:
        table, starts = _served(table)
        codes = _numbered(table.column("resource"))
        taken: set[int] = set()
        keep: list[int] = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            free = [i for i in range(lo, hi) if codes[i] < 0 or codes[i] not in taken]
            mine = free[: policy.target(len(free)) or 0]
            keep += mine
            taken.update(codes[i] for i in mine if codes[i] >= 0)
        return table.select(columns).take(pa.array(keep, pa.int64()))

    turns = max(-(-anchors.count() // TURN), 1)
    parts = written(anchors.repartitionByRange(turns, "a_ord", "a_id").withColumn("turn", F.spark_partition_id()), "turns")
    done: DataFrame | None = None
    for turn in sorted(r[0] for r in parts.select("turn").distinct().collect()):  # one number per TURN anchors
        now = edges.join(parts.where(F.col("turn") == turn).drop("turn"), ["a_ord", "a_id"], "left_semi")
        if done is not None:
            now = now.join(done.where("resource is not null").select("resource").distinct(), "resource", "left_anti")
        ranked = now.withColumn("rank", F.row_number().over(Window.partitionBy(*ANCHOR).orderBy(*order)))
        ranked = ranked.withColumn("task", F.lit("") if together else F.col("grp"))
        got = ranked.groupBy("task").applyInArrow(run, schema)
        after = written(got if done is None else done.unionByName(got), "turn")
        if done is not None:
            forget(done)
        done = after
    return edges.select(*TAKEN).where("false") if done is None else done.select(*TAKEN)
