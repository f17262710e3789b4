"""BM25 over postings that are written once; terms are joined as strings, so none collide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS, Settings
from ..storage import new_path

#: Folders of postings; a search reads those of its terms.  A large corpus wants more.
BUCKETS = 16
#: Files of a folder, about: a frequent term is spread over them.
SPREAD = 4
#: Query terms that are broadcast; a larger query set is joined by shuffle.
BROADCAST_TERMS = 200_000


def tf_weight(tf: Column, doc_len: Column, avgdl: Column, s: Settings = DEFAULTS) -> Column:
    """The saturating half of the score; without an average length, the document's own (or 1) stands in."""
    mean = F.when(avgdl > 0, avgdl).otherwise(F.when(doc_len > 0, doc_len.cast("double")).otherwise(F.lit(1.0)))
    tf = tf.cast("double")
    return tf * F.lit(s.k1 + 1) / (tf + F.lit(s.k1) * (F.lit(1.0 - s.b) + F.lit(s.b) * doc_len.cast("double") / mean))


def idf(df: Column, n_docs: Column) -> Column:
    df, n = df.cast("double"), n_docs.cast("double")
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id and each distinct term, from query_id and text."""
    return queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class SparseIndex:
    """postings (term, doc_id, tf, doc_len, bucket), terms (term, df), totals (one row: n_docs, total_len, avgdl) and the number of buckets."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    buckets: int


_POSTINGS = "term string, doc_id long, tf int, doc_len int, bucket int"


def posted(words: Column) -> Column:
    """An array of term, tf and doc_len of one document's words, of which there is one at least: counted in the row itself, without a shuffle."""

    def runs(ws: Column) -> Column:  # of sorted words
        starts = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        run = lambda at: F.transform(at, lambda i, k: F.struct(F.get(ws, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ws)) - i).alias("tf"), F.size(ws).alias("doc_len")))
        return F.transform(F.array(starts), run)[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]  # outer functions compute their argument once


def write_index(docs: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> SparseIndex:
    """Encode doc_id (one row each) and text once, for any number of searches, in folders below `path`.

    One shuffle brings postings to the folders of their terms' hashes, where they are sorted by term.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "sparse-index")
    analyzed = docs.select(F.col("doc_id").cast("long"), T.terms(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    postings = analyzed.select("doc_id", F.inline(posted(F.col("words")))).withColumn("bucket", bucket(F.col("term"), buckets))
    postings = postings.select("term", "doc_id", "tf", "doc_len", "bucket").repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    postings.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    rows = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    rows.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    n = docs.count()
    totals = rows.agg(F.lit(n).cast("long").alias("n_docs"), F.coalesce(F.sum(F.col("tf").cast("long")), F.lit(0)).alias("total_len"))
    mean = F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(F.lit(0.0))
    totals.withColumns({"avgdl": mean, "buckets": F.lit(buckets)}).coalesce(1).write.parquet(f"{path}/totals")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> SparseIndex:
    """The index below `path`."""
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    terms = spark.read.schema("term string, df long").parquet(f"{path}/terms")
    totals = spark.read.schema("n_docs long, total_len long, avgdl double, buckets int").parquet(f"{path}/totals")
    return SparseIndex(postings, terms, totals.drop("buckets"), totals.first()["buckets"])


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_k_sparse, keep: Column | None = None, s: Settings = DEFAULTS, index: SparseIndex | None = None) -> DataFrame:
    """query_id, doc_id, score (6 places) and rank of the k best documents that share a term with a query.

    `keep`, over columns of docs, restricts which documents are returned, not the
    statistics.  Only the postings of terms that some query has are read; without an
    index one is written first.
    """
    index = index or write_index(docs)
    asked = query_terms(queries)
    wanted = asked.select(bucket(F.col("term"), index.buckets).alias("b")).distinct().collect()  # no more than there are
    weights = asked.join(index.terms, "term").join(F.broadcast(index.totals), how="cross")  # totals: one row
    weights = weights.select("query_id", "term", "avgdl", idf(F.col("df"), F.col("n_docs")).alias("idf")).where("idf > 0")
    if asked.count() <= BROADCAST_TERMS:
        weights = F.broadcast(weights)
    postings = index.postings.where(F.col("bucket").isin([r.b for r in wanted])) if wanted else index.postings.where(F.lit(False))
    if keep is not None:
        postings = postings.join(docs.where(keep).select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    scored = postings.join(weights, "term").withColumn("part", F.col("idf") * tf_weight(F.col("tf"), F.col("doc_len"), F.col("avgdl"), s))
    scores = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scores, k)


def ranked(scores: DataFrame, k: int | None = None, key: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds rank (from 1) by falling score, ties to the smaller item; the k first ones if k is given."""
    found = scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item)))
    return found.where(F.col("rank") <= k) if k else found
