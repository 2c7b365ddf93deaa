"""Connected components of a distributed edge table (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Links (of two numbers) that one task may hold; so few meet in one partition, whose rounds need no exchange.
ONE_TASK = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def both_ways(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """u, v: each link in both directions."""
    one, two = F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))
    return links.select(F.inline(F.array(one, two)))


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``id, component`` for each end of ``links`` (columns a, b).

    ``component`` is the smallest id that links reach.  Each round replaces every
    edge by an edge to the smallest neighbour; minima are pre-aggregated before
    they are shuffled, and the join back is one that Spark can split, so a node
    with very many links does not meet in one task.  The rounds stop when the
    edges no longer change (about the logarithm of a component's size).  At most
    ``one_task`` links go through the same rounds in one partition.  Links of a node
    with itself are ignored; no links give no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before, state = None, _state(edges)
    alone = state[0] <= one_task

    def placed(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if alone else df

    def toward(edges: DataFrame, least: DataFrame) -> DataFrame:
        return edges.join(least.hint("merge") if alone else least, "u")

    edges = placed(edges)
    while state != before:
        before = state
        # large star: each larger neighbour of u moves to the smallest of u's neighbourhood
        both = both_ways(edges, "u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = toward(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = toward(edges, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(placed(moved.unionByName(least.select("u", F.col("m").alias("v")))).distinct())
        state = _state(edges)
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return placed(leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
