"""Connected components of a graph too large for one task, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _lowest(edges: DataFrame) -> DataFrame:
    """u, v and low: the smaller of u and its smallest neighbour."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return edges.join(low, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the smallest node of its component), for each node of an undirected edge list u, v of numbers or texts.

    A round links every larger neighbour of a node to its smallest one, then every
    smaller neighbour; components end as stars after a number of rounds that grows with
    the logarithm of their size.  Each round's edges are written to the shared folder.
    """
    e = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    state = mark(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        lowest = _lowest(large)
        small = lowest.select("u", F.col("low").alias("v")).union(lowest.select(F.col("v").alias("u"), F.col("low").alias("v")))
        after = written(small.where("u != v").distinct(), "edges")
        discard(e)
        e, before = after, state
        if (state := mark(e)) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
