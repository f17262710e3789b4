"""Metrics of queues and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import monitoring as O
from ..settings import DURATION_BUCKETS
from .maintenance import outbox
from .registry import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("select count(*) filter (event_type in ('view', 'click'))::bigint as n_pending, count(*) filter (event_type = 'signup')::bigint as n_processing, count(*) filter (event_type = 'error')::bigint as n_failed from events")
def queue_depths(spark, sf_dir):
    return O.queue_depths(outbox(spark, sf_dir), ["pending", "processing", "failed"])


@query("select event_type, round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95, round(quantile_disc(value, 0.99), 6) as p99 from events group by event_type")
def latency_percentiles(spark, sf_dir):
    """Nearest rank."""
    found = E.nearest_percentiles(events(spark, sf_dir).select("event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query(
    """with o as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events)
    select event_type, round(max(value) filter (k = least(n - 1, floor(n * 0.5e0))), 6) as p50, round(max(value) filter (k = least(n - 1, floor(n * 0.95e0))), 6) as p95 from o group by event_type"""
)
def latency_pct_floor(spark, sf_dir):
    """The other definition, by floor of the place."""
    found = E.floor_percentiles(events(spark, sf_dir).select("event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("select event_type, count(*)::bigint as n, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000e0, 6) as per_second from events group by event_type")
def throughput(spark, sf_dir):
    us = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / us * F.lit(1000000.0), 6).alias("per_second"))


_BOUNDS = ", ".join(f"('{b}', {b}e0)" for b in DURATION_BUCKETS)


@query(f"with b(le, bound) as (values {_BOUNDS}, ('+Inf', 'infinity'::double)) select event_type, le, count(*) filter (value <= bound)::bigint as n from events, b group by event_type, le")
def metric_histogram(spark, sf_dir):
    return O.histogram(events(spark, sf_dir), ["event_type"], "value")


@query("select event_type, user_id % 2 = 0 as degraded, count(*)::bigint as n from events group by all")
def metric_counters(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 2 == 0).alias("degraded")).agg(F.count("*").alias("n"))


_SLIDES = "(select event_type, value, (epoch_us(ts) // 1000000 // 900 - k) * 900 as start from events, (select unnest(range(4)) as k))"


@query(f"select event_type, start::bigint as start, count(*)::bigint as n, round(count(*) / 3600e0, 6) as rate, round(quantile_disc(value, 0.95), 6) as p95 from {_SLIDES} group by all")
def sliding_rate(spark, sf_dir):
    """Counts, rates and a percentile of windows of an hour, every quarter of an hour."""
    found = O.sliding(events(spark, sf_dir), "ts", ["event_type"], "1 hour", "15 minutes", F.count("*").alias("n"), E.nearest_rank("value", 0.95).alias("p95"))
    return found.select("event_type", F.unix_seconds("window.start").alias("start"), "n", F.round(F.col("n") / F.lit(3600.0), 6).alias("rate"), F.round("p95", 6).alias("p95"))


@query(
    """with h as (select event_type, epoch_us(ts) // 1000000 // 3600 * 3600 as t, count(*) as n from events group by all), m as (select event_type, avg(n) as a from h group by 1),
    f as (select h.event_type, t, row_number() over (partition by h.event_type order by t) as k from h join m using (event_type) where n >= a),
    r as (select event_type, t - k * 3600 as run, min(t) as start, count(*) as steps from f group by all)
    select event_type, start::bigint as start, steps::bigint as steps from r where steps >= 2"""
)
def alert_for(spark, sf_dir):
    """Times in which an hourly count stays at or above its mean for two hours or more."""
    hours = events(spark, sf_dir).withColumn("t", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).groupBy("event_type", "t").agg(F.count("*").alias("n"))
    means = hours.groupBy("event_type").agg(F.avg("n").alias("a"))
    return O.held(hours.join(means, "event_type"), "t", F.col("n") >= F.col("a"), ["event_type"], 3600, 2)


@query("select event_type, least(6, greatest(1, ceil(count(*) / 400.0)))::int as replicas from events group by event_type")
def autoscale(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(O.replicas(F.count("*"), 400).alias("replicas"))
