"""Counters, histograms, rates and alerts over a stream of events, as batch or streaming aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DURATION_BUCKETS


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float] = DURATION_BUCKETS) -> DataFrame:
    """keys, le (upper bound, or +Inf) and n: cumulative counts, all in one pass."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{k}") for k, b in enumerate(bounds)]
    one = rows.groupBy(*keys).agg(*counts, F.count(value).alias("_all"))
    lines = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_{k}").alias("n")) for k, b in enumerate(bounds)]
    return one.select(*keys, F.inline(F.array(*lines, F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))))


def queue_depths(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """One row with a count for each status."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses])


def sliding(rows: DataFrame, ts: str, keys: list[str], width: str, slide: str, *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates of sliding windows; on a stream `late` is how long to wait, which bounds the state."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(F.window(ts, width, slide).alias("window"), *keys).agg(*aggregates)


def held(series: DataFrame, time: str, firing: Column, keys: list[str], step: int, least: int) -> DataFrame:
    """Runs of consecutive steps (of `step` seconds) in which a condition holds, of `least` steps or more: keys, start, steps."""
    hot = series.where(firing).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(time)))
    runs = hot.withColumn("_run", F.col(time) - F.col("_k") * step).groupBy(*keys, "_run").agg(F.min(time).alias("start"), F.count("*").alias("steps"))
    return runs.where(F.col("steps") >= least).drop("_run")


def replicas(depth: Column, each: int = 10, least: int = 1, most: int = 6) -> Column:
    """Workers that a queue of this depth asks for."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(depth / each).cast("int")))
