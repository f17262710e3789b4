"""Operator 8: exact deduplication with streaming state.

Texts are equal when they agree after all ASCII white space is deleted.  A row's
digest, its length, its identifier and its locator (file and row) go through a
Structured Streaming aggregation whose state is keyed by the digest, kept on disk
(RocksDB) and in the checkpoint, and never expires.  For each digest the state retains
the row that stays (most code points, then smallest doc_id, null last, then locator),
and how many rows there are.  New batches of rows meet the state of all earlier ones.

A hit counts only when the full bytes agree: the texts of all groups of two rows or more
are fetched by their locators and compared with the text that stays.  Should a digest
ever stand for different texts, its rows are grouped by another, longer one.

Plan: state is updated after partial sums, so a group of any size sends one row from
each task; rows meet their group's state by skew_safe_join; texts of groups of one are
sifted out where they are read, the rest is compared by salt, so that a task gets about
SALT_ROWS rows of one group.

Cases: a null text counts as empty; empty texts are equal to one another; of rows equal
in text and doc_id the first by locator stays; a null doc_id sorts last, and a row is
`kept` by its locator, not its identifier; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, located, new_path, sifted, skew_safe_join, written

#: Rows of one group that a task compares, about.
SALT_ROWS = 1000
#: Rows in a partition of the state, about: each partition's store takes 4 MB of disk and more, however few rows it holds.
STATE_ROWS = 10_000
STATE_PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and the locator (file, row) of each row."""
    return located(docs, "doc_id", "text").select(F.col("_c0").cast("long").alias("doc_id"), F.col("_c1").alias("text"), F.col("_file").alias("file"), F.col("_row").alias("row"))


def contents(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """digest, n (code points), doc_id and locator of located rows."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    return rows.select(digest(normal(F.col("text"))).alias("digest"), n.alias("n"), "doc_id", "file", "row")


def stays() -> Column:
    """A struct that is smallest for the row that stays."""
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def deduplicated(stream: DataFrame, checkpoint: str, out: str, once: bool = True, rows: int | None = None) -> int:
    """Run a stream of contents() against the state in `checkpoint`; each batch's changed groups go to `out`.

    Returns the number of batches.  With once=True it ends when all rows there are have
    been read; a later call with the same folders goes on from the state.  A new state
    has as many partitions as a shuffle, or fewer where `rows` says that few rows come.
    """
    spark = stream.sparkSession
    settings = dict(STATE)
    if rows is not None:
        settings[STATE_PARTITIONS] = str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, rows // STATE_ROWS + 1)))
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    state = stream.groupBy("digest").agg(F.min(stays()).alias("keep"), F.count("*").alias("group_size"))
    batches: list[int] = []

    def changed(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # a repeated batch replaces itself
        batches.append(batch)

    try:
        writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(changed)
        (writer.trigger(availableNow=True) if once else writer).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return len(batches)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The state's groups as the last batch that changed each one left them."""
    schema = "digest binary, keep struct<n:int,no_id:boolean,doc_id:bigint,file:string,row:bigint>, group_size bigint"
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", out).parquet(out)
    return rows.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max("group_size").alias("group_size"))


def grouped(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """digest, doc_id, file, row, keep (struct) and group_size of every row, checked byte by byte."""
    spark = docs.sparkSession
    rows = rows_of(docs)
    content = contents(rows, digest)
    folder, out = new_path(spark, "dedup-contents"), new_path(spark, "dedup-state")
    content.write.parquet(folder)
    content = spark.read.schema(content.schema).parquet(folder)
    total = content.count()
    if not total:
        return content.select("digest", "doc_id", "file", "row", stays().alias("keep"), F.lit(0).cast("long").alias("group_size"))
    batches = deduplicated(spark.readStream.schema(content.schema).parquet(folder), new_path(spark, "dedup-checkpoint"), out, rows=total)
    state = latest(spark, out) if batches > 1 else spark.read.parquet(f"{out}/batch=0").select("digest", "keep", "group_size")
    found = written(skew_safe_join(content.select("digest", "doc_id", "file", "row"), state, "digest", "group_size", total), "dedup-groups")
    wrong = written(differing(rows, found), "dedup-differing")
    if wrong.isEmpty():
        return found
    bad = found.join(wrong, "digest", "left_semi").join(rows.drop("doc_id"), ["file", "row"])
    by_text = bad.select(F.unhex(F.sha2(normal(F.col("text")), 512)).alias("same"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), "digest", "doc_id", "file", "row")
    groups = by_text.groupBy("same").agg(F.min(stays()).alias("keep"), F.count("*").alias("group_size"))
    again = skew_safe_join(by_text, groups, "same", "group_size", total)
    return found.join(wrong, "digest", "left_anti").unionByName(again.select(found.columns))


def differing(rows: DataFrame, found: DataFrame) -> DataFrame:
    """digest of each group in which some row's full text is not the text that stays."""
    many = found.where("group_size > 1").withColumn("first", (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    many = many.select("file", "row", "digest", "first", salts.alias("salts"), F.pmod(F.hash("file", "row"), salts).alias("salt"))
    texts = sifted(rows.select("file", "row", "text"), many, ["file", "row"]).join(many, ["file", "row"])
    texts = texts.withColumn("same", normal(F.col("text"))).drop("text", "file", "row")
    firsts = texts.where("first").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("same").alias("kept"))
    others = texts.where("not first").select("digest", "salt", "same")
    return others.join(firsts, ["digest", "salt"]).where("same != kept").select("digest").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) of every row."""
    found = grouped(docs)
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: DuckDB SQL for exact_dedup(), where doc_id is unique.
EXACT_DEDUP_SQL = rf"""
with own as (select doc_id, coalesce(length(text), 0) as n, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') as same from documents),
ranked as (select *, row_number() over (partition by same order by n desc, doc_id) as k, count(*) over (partition by same) as c,
  first_value(doc_id) over (partition by same order by n desc, doc_id) as keep_id from own)
select doc_id, keep_id, c::bigint as group_size, k = 1 as kept, sha256(same) as text_sha256 from ranked"""
