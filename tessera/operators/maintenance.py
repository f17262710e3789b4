"""Incremental maintenance as set operations: reconciliation, upserts, deletes, queues.

Tables are versioned: a change yields a new version, which a reader pins by name.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings


def reconcile(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id", content: str = "content_sha256") -> DataFrame:
    """key and action of every chunk on either side: unchanged, updated, inserted or deleted; only the content decides."""
    old, new = existing.select(key, F.col(content).alias("_old"), F.lit(True).alias("_in_old")), incoming.select(key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_new").isNull(), "deleted").when(F.col("_in_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return old.join(new, key, "full").select(key, action.alias("action"))


def term_deltas(actions: DataFrame, old_terms: DataFrame, new_terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """term and delta of document frequencies: old terms of updated and deleted chunks go, new ones of updated and inserted come."""
    gone = old_terms.join(actions.where("action in ('updated', 'deleted')"), key, "left_semi").select("term", F.lit(-1).alias("d"))
    come = new_terms.join(actions.where("action in ('updated', 'inserted')"), key, "left_semi").select("term", F.lit(1).alias("d"))
    return gone.unionByName(come).groupBy("term").agg(F.sum("d").alias("delta")).where("delta != 0")


def apply_term_deltas(df: DataFrame, deltas: DataFrame) -> DataFrame:
    """term and df after deltas; no frequency falls below 0."""
    both = df.join(deltas, "term", "full")
    return both.select("term", F.greatest(F.lit(0), F.coalesce("df", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast("long").alias("df"))


def corpus_delta(actions: DataFrame, old_lengths: DataFrame, new_lengths: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: the changes of the number of chunks and of their total length."""
    both = actions.join(old_lengths.select(key, F.col("doc_len").alias("_old")), key, "left").join(new_lengths.select(key, F.col("doc_len").alias("_new")), key, "left")
    n = F.when(F.col("action") == "inserted", 1).when(F.col("action") == "deleted", -1).otherwise(0)
    old, new = F.coalesce("_old", F.lit(0)), F.coalesce("_new", F.lit(0))
    length = F.when(F.col("action") == "inserted", new).when(F.col("action") == "deleted", -old).when(F.col("action") == "updated", new - old).otherwise(0)
    return both.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_delta"), F.coalesce(F.sum(length), F.lit(0)).alias("len_delta"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with changes (a row for each key) in place of rows of the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def upsert_latest(table: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As upsert, for changes with several rows of a key: the last by `order` counts."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return upsert(table, changes.withColumn("_n", last).where("_n = 1").drop("_n").select(table.columns), key)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def cascade(documents: DataFrame, children: dict[str, DataFrame], parent: str = "document_id") -> dict[str, DataFrame]:
    """Each child table without rows whose parent is gone."""
    return {name: child.join(documents.select(parent), parent, "left_semi") for name, child in children.items()}


def backfill(table: DataFrame, vectors: DataFrame, key: str, column: str) -> DataFrame:
    """The table with values of `vectors` where it has some."""
    new = vectors.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(table.columns)


def stale(chunks: DataFrame, vectors: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """Keys of chunks without a vector, or with one of another model (a missing model is another one)."""
    both = chunks.select(key).join(vectors.select(key, "dense", "model"), key, "left")
    return both.where(F.col("dense").isNull() | ~F.col("model").eqNullSafe(F.lit(model))).select(key)


def enqueue(chunks: DataFrame, outbox: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys to add to the outbox: chunks with a vector that have no pending row yet, each once."""
    return chunks.where(F.col("dense").isNotNull()).select(key).distinct().join(outbox.where("status = 'pending'").select(key), key, "left_anti")


def claim(queue: DataFrame, n: int, attempts: int | None = None) -> DataFrame:
    """The n oldest pending rows (with fewer attempts than `attempts`), as they are after the claim."""
    open_ = queue.where("status = 'pending'")
    open_ = open_ if attempts is None else open_.where(F.col("attempts") < attempts)
    return open_.orderBy("id").limit(n).withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1)


def after_failure(attempts: Column, most: int) -> Column:
    """The status after one more failed attempt."""
    return F.when(attempts + 1 >= most, F.lit("failed")).otherwise(F.lit("pending"))


def overdue(since: Column, minutes: int, as_of: datetime) -> Column:
    return since < F.lit(as_of).cast("timestamp") - F.expr(f"interval {minutes} minutes")


def reap(jobs: DataFrame, as_of: datetime, s: Settings = DEFAULTS) -> DataFrame:
    """Jobs after reaping: those stuck in processing become pending, or dead after the last attempt; the error tells."""
    stuck = (F.col("status") == "processing") & overdue(F.col("started_at"), s.stuck_minutes, as_of)
    dead = F.col("attempts") >= s.job_attempts
    error = F.concat(F.coalesce("last_error", F.lit("")), F.lit(f" [reaped: stuck over {s.stuck_minutes} min]"))
    return jobs.withColumns({"status": F.when(stuck & dead, "dead").when(stuck, "pending").otherwise(F.col("status")), "last_error": F.when(stuck, error).otherwise(F.col("last_error"))})


def fenced_finish(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after results (id, worker_id, outcome); a result counts only if its worker still holds the job.

    Adds applied: null without a result, else whether it counted.
    """
    both = jobs.join(results.select("id", F.col("worker_id").alias("_by"), "outcome"), "id", "left")
    holds = (F.col("status") == "processing") & F.col("worker_id").eqNullSafe(F.col("_by"))
    applied = F.when(F.col("outcome").isNotNull(), holds)
    return both.withColumn("applied", applied).withColumn("status", F.when(F.col("applied"), F.col("outcome")).otherwise(F.col("status"))).drop("_by", "outcome")


def drained(index: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """The index after upserts, then tombstones: a key whose last operation is a delete is gone.

    operations has the key, seq, op (upsert or delete) and the index's other columns.
    """
    rank = F.when(F.col("op") == "delete", 1).otherwise(0)  # within one batch deletes come last
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq"), F.desc(rank)))
    final = operations.withColumn("_n", last).where("_n = 1")
    kept = index.join(final.select(key), key, "left_anti")
    return kept.unionByName(final.where("op = 'upsert'").select(index.columns))
