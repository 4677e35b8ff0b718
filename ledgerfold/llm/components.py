"""Connected components of a graph held as edges, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._common import Scratch, join_each


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node goes to the least node among its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_each(both.where("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return (
        join_each(down, least, "a", "n", total)
        .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .where("a <> b")
    )


def star_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of its component.

    Each round is written, so that a lost executor repeats one round at most. The
    least neighbour is found by aggregation and met by a join, never by gathering
    a node's neighbours; hubs, of which there can be few, are met by broadcast.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def stamp(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())

    mark = stamp(now)
    if mark[0]:
        for _ in range(max_rounds):
            after = scratch.write(_small_star(_large_star(now, mark[0]).distinct(), mark[0]).distinct())
            scratch.drop(now)
            now, was, mark = after, mark, stamp(after)
            if mark == was:
                break
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
