"""Readers and writers of raw pages, ticker lists, shards and vectors; paths of any Hadoop file system."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from ..storage import numbered

DOCUMENT = "id string, name string, source_type string, gcs_uri string, tenant string, region string, tags array<string>, meta string, status string, error string, created_at timestamp, updated_at timestamp"
CHUNK = "id string, document_id string, chunk_index int, section_chunk_index int, text string, context_header string, page_number int, section string, section_title string, is_narrative boolean, token_count int, char_count int, content_sha256 string, tenant string, region string, embedding_model string, chunk_config string, created_at timestamp"
CHUNK_VECTOR = "chunk_id string, dense array<float>, sparse_tf map<bigint,int>, doc_len int, model string, created_at timestamp"
JOB = "id bigint, document_id string, status string, attempts int, last_error string, worker_id string, started_at timestamp, finished_at timestamp, created_at timestamp"
OUTBOX = "id bigint, chunk_id string, status string, attempts int, last_error string, created_at timestamp, synced_at timestamp"
TOMBSTONE = "id bigint, chunk_id string, status string, attempts int, created_at timestamp, synced_at timestamp"
VECTOR_LINE = "chunk_id string, dense array<float>, model string"


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path and html of files; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """ticker and cik from a JSON object of numbered entries."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str:bigint,ticker:string>>"))).alias("e"))
    return entries.select(F.upper("e.ticker").alias("ticker"), F.col("e.cik_str").cast("string").alias("cik"))


def comment_stripped(line: Column) -> Column:
    """A line without its comment and outer blanks, in upper case; null if nothing is left."""
    return F.nullif(F.upper(F.trim(F.split(line, "#", 2)[0])), F.lit(""))


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(comment_stripped(F.col("value")).alias("ticker")).where("ticker is not null")


def latest_of_kind(parallel: DataFrame, key: str, arrays: list[str], kind: Column, n: int = 1) -> DataFrame:
    """The first n entries of a kind from parallel arrays, in their order: key, nth, and a column for each array.

    kind is a condition over column `entry`, which has a field for each array.
    """
    rows = parallel.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "entry")).where(kind)
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("nth") <= n)
    return ranked.select(key, "nth", *[F.col(f"entry.{a}").alias(a) for a in arrays])


def skip_existing(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet: what a repeated upload still has to write."""
    return new.join(existing.select(key), key, "left_anti")


def with_shard(rows: DataFrame, order: list[str], group: str, size: int = DEFAULTS.shard_rows) -> DataFrame:
    """Adds shard: the number of `size` rows before it in the order of group and `order`; no task numbers all rows, or all of a group."""
    return numbered(rows, [group, *order], "_k").withColumn("shard", F.floor(F.col("_k") / size).cast("long")).drop("_k")


def write_shards(rows: DataFrame, path: str) -> None:
    """JSON lines, one folder for each shard."""
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def read_vector_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR_LINE).json(path)


def read_vector_arrays(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id and dense from pairs of files <shard>.ids.json and <shard>.f16.npy; a pair of different lengths is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,npy}").load(path)
    shard = F.regexp_extract("path", r"([^/]+)\.(ids\.json|f16\.npy)$", 1)
    pairs = files.groupBy(shard.alias("shard")).agg(
        F.max(F.when(F.col("path").endswith(".ids.json"), F.col("content"))).alias("ids"),
        F.max(F.when(F.col("path").endswith(".f16.npy"), F.col("content"))).alias("matrix"),
    )

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, ids, matrix in batch.itertuples(index=False):
                names, rows = json.loads(bytes(ids)), np.load(io.BytesIO(bytes(matrix)))
                if len(names) != len(rows):
                    raise ValueError(f"shard {shard}: {len(names)} ids and {len(rows)} vectors")
                yield pd.DataFrame({"chunk_id": names, "dense": list(rows.astype("float32"))})

    return pairs.mapInPandas(load, "chunk_id string, dense array<float>")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id (the line's number in order of id) and text of a file of questions, as JSON lines with id and query."""
    rows = spark.read.schema("id string, query string").json(path).where("query is not null")
    return numbered(rows, ["id", "query"], "query_id").select("query_id", F.col("query").alias("text"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """query, phrases that a relevant text holds, and a section (may be null) of labelled questions, as JSON lines."""
    return spark.read.schema("query string, anchors array<string>, section string").json(path).where("query is not null")
