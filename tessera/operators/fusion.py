"""Fusion of ranked lists: one row for each query and item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS


def stacked(lists: dict[str, DataFrame]) -> DataFrame:
    """query_id, doc_id, score, rank, source and list (its place, from 0) of ranked lists by source name."""
    out = None
    for k, (source, df) in enumerate(lists.items()):
        part = df.select("query_id", "doc_id", "score", "rank", F.lit(source).alias("source"), F.lit(k).alias("list"))
        out = part if out is None else out.unionByName(part)
    return out


def _ordered(fused: DataFrame) -> DataFrame:
    """Rank by falling score, ties in the order in which the lists first showed the item."""
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "first.list", "first.rank")
    return fused.withColumn("fused_rank", F.row_number().over(order))


def rrf(lists: dict[str, DataFrame], k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion: query_id, doc_id, fused_score, fused_rank and source_ranks (source to rank)."""
    fused = stacked(lists).groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("fused_score"),
        F.min(F.struct("list", "rank")).alias("first"),
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("list", "source", "rank"))), lambda x: F.struct(x["source"], x["rank"]))).alias("source_ranks"),
    )
    return _ordered(fused).select("query_id", "doc_id", "fused_score", "fused_rank", "source_ranks")


def weighted(lists: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted sum of scores scaled to 0 to 1 within each list; a list of equal scores counts as 1."""
    rows = stacked(lists)
    inside = Window.partitionBy("query_id", "source")
    low, high = F.min("score").over(inside), F.max("score").over(inside)
    weight = F.create_map(*[F.lit(x) for source in lists for x in (source, weights.get(source, 0.0))])[F.col("source")]
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    fused = rows.withColumn("part", weight * scaled).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("fused_score"), F.min(F.struct("list", "rank")).alias("first"))
    return _ordered(fused).select("query_id", "doc_id", "fused_score", "fused_rank")
