"""Term statistics: frequencies, lengths and corpus totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def term_frequencies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf: all words of a document lie in one task, so partial sums are complete before the shuffle."""
    return docs.select(key, F.explode(T.terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and doc_len, the number of words that count; no shuffle."""
    return docs.select(key, F.size(T.terms(F.coalesce("text", F.lit("")))).cast("long").alias("doc_len"))


def corpus_totals(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, total_len and avgdl (0 for an empty corpus)."""
    totals = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
    return totals.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(F.lit(0.0)))


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    """term and df; frequencies has a row for each document and term."""
    return frequencies.groupBy("term").agg(F.count("*").alias("df"))
