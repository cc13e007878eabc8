"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import staged


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges with a > b. Each node hands its smaller neighbours and itself to the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b) but the roots themselves; a root is its component's least node.

    Minima are partial aggregates and the joins have one unique side, so a node with very many links is never
    gathered in one place. Each round is written to the shared folder; rounds grow with the logarithm of the
    longest chain.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    e = staged(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    sums = F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)
    state = e.agg(*sums).first()
    while state[0]:
        e = staged(_small_star(_large_star(e)), "stars")
        after = e.agg(*sums).first()
        if after == state:
            break
        state = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
