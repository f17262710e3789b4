"""Search quality, latency percentiles and consistency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import ranged

KS = (1, 5, 10)


def golden_metrics(results: DataFrame, relevant: DataFrame, ks=KS) -> DataFrame:
    """hit@k and reciprocal rank (over the whole list) of each question that has relevant documents."""
    asked = relevant.select("query_id").distinct()
    first = results.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = asked.join(first, "query_id", "left")
    hits = [F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks]
    return rows.select("query_id", *hits, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def mean_metrics(metrics: DataFrame, ks=KS) -> DataFrame:
    """One row: means to 4 places."""
    return metrics.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(f"hit_{k}"), 4).alias(f"hit_{k}") for k in ks], F.round(F.avg("rr"), 4).alias("mrr"))


def ann_recall(found: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """recall@k (of the first k true ones, as many as there are) and reciprocal rank of the true first one, by question."""
    both = truth.select("query_id", "doc_id", F.col("rank").alias("true_rank")).join(found.select("query_id", "doc_id", F.col("rank").alias("found_rank")), ["query_id", "doc_id"], "left")
    recalls = [F.round(F.count_if((F.col("true_rank") <= k) & (F.col("found_rank") <= k)) / F.least(F.lit(k), F.count("*")), 5).alias(f"recall_{k}") for k in ks]
    rr = F.coalesce(F.max(F.when(F.col("true_rank") == 1, 1.0 / F.col("found_rank"))), F.lit(0.0))
    return both.groupBy("query_id").agg(*recalls, F.round(rr, 5).alias("rr"))


def nearest_rank(column: str, q: float):
    """The percentile that is a value of the data: the one at place ceil(q * n)."""
    return F.expr(f"percentile_disc({q}) within group (order by {column})")


def at_places(rows: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each key the values at given places, from 1 on, of its values in order; a place is a function of their number.

    Equal values are counted first; their running counts are sums within ranges of key and
    value plus the ranges before, so a key with any share of the rows is no one task's.
    """
    counts = ranged(rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n")), [key, value], "counted")
    parts = counts.groupBy(key, "_part").agg(F.sum("_n").alias("_sum"))
    every = Window.partitionBy(key)
    parts = parts.select(key, "_part", (F.sum("_sum").over(every.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(every).alias("_all"))
    until = F.sum("_n").over(Window.partitionBy("_part", key).orderBy(value))
    found = counts.withColumn("_inside", until).join(parts, [key, "_part"]).withColumn("_until", F.col("_before") + F.col("_inside"))
    at = lambda place: (place > F.col("_until") - F.col("_n")) & (place <= F.col("_until"))
    return found.groupBy(key).agg(*[F.max(F.when(at(place(F.col("_all"))), F.col(value))).alias(name) for name, place in places.items()])


def nearest_percentiles(rows: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """By key the values at place ceil(q * n), 1 at least."""
    return at_places(rows, key, value, {name: lambda n, q=q: F.greatest(F.lit(1), F.ceil(n * F.lit(q))) for name, q in qs.items()})


def floor_percentiles(rows: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """The other definition: the value at place floor(n * q), from 0 on, at most the last."""
    return at_places(rows, key, value, {name: lambda n, q=q: F.least(n, F.floor(n * F.lit(q)) + 1) for name, q in qs.items()})


def drift(truth: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """key and kind: missing from the index, or stray in it."""
    missing = truth.select(key).join(have.select(key), key, "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(have.select(key).join(truth.select(key), key, "left_anti").withColumn("kind", F.lit("stray")))
