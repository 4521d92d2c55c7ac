"""Connected components of a link table, by alternating large-star and small-star rounds.

Links never leave the executors. Each round is a map-side minimum and a join
back; its result is a table in the shared folder, so lineage stays one round
deep. The rounds end when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import discard, scratch, small_side, written


def components(links: DataFrame, u="u", v="v") -> DataFrame:
    """(node, root) for each node of ``links``, root being the least node it reaches.

    Nodes are longs. Loops, repeated links and both directions may occur. An
    empty table gives an empty result.
    """
    lower, upper = F.least(u, v), F.greatest(u, v)
    edges = written(links.select(lower.alias("a"), upper.alias("b")).where("a < b").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        before = edges
        with scratch():
            edges = written(_small_star(_large_star(edges)), "links", outer=True)
        now = _mark(edges)
        discard(before)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Two tables of links with one mark are equal but for a chance in 2**64."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).first())


def _star(pairs: DataFrame) -> DataFrame:
    """(n, m, low): each pair with the least of the node and its neighbours in ``pairs``."""
    least = written(pairs.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")), "least")
    return pairs.join(small_side(least, 16), "n")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select("b", "a"))
    return _star(both).where("m > n").select(F.col("low").alias("a"), F.col("m").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("m"))
    moved = _star(down)
    return moved.select(F.col("low").alias("a"), F.col("m").alias("b")).union(moved.select("low", "n")).where("a < b").distinct()
