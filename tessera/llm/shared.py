"""Helpers that several training-data operators use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, new_path, shared_dir, written  # noqa: F401

#: ASCII white space as the query contracts name it, for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key counts as hot when it holds over 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000

#: Rows in an Arrow batch: texts can be long, and two Python workers share an executor.
ARROW_ROWS = 1000


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_memos: dict[str, dict] = {}


def memos(operator: str) -> dict:
    """What an operator remembers between the tasks of a Python worker."""
    return _memos.setdefault(operator, {})


def spare(operator: str = "") -> None:
    """Forgets what other operators remember in this process, and gives free memory back to the system."""
    others = [m for name, m in _memos.items() if name != operator and m]
    for m in others:
        m.clear()
    if others:
        gc.collect()  # memos refer to their owners
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable, operator: str = "") -> Callable:
    """A function over Arrow batches that begins and ends with spare().

    Spark hands a Python worker on to tasks of any later stage, so without this an executor
    holds the memos of the operators before beside what a task needs.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare(operator)
        yield from run(batches)
        spare(operator)

    return task


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; a null identifier counts as the empty text, which gives 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hot_keys(counted: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Keys with over total/HOT_SHARE rows: at most HOT_SHARE of them, so safe to broadcast."""
    return counted.where(F.col(count) > max(total // HOT_SHARE, 1)).select(key)


def skew_safe_join(rows: DataFrame, unique: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to a table that is unique on a non-null key, whatever share of the rows one key holds.

    The at most HOT_SHARE heavy keys (by the count column of `unique`) join by
    broadcast, so their rows stay where they are; all others are shuffled and no key
    among them holds over 1/HOT_SHARE of the rows.  how is inner or left.
    """
    limit = max(total // HOT_SHARE, 1)
    heavy = unique.where(F.col(count) > limit)
    light = unique.where(F.col(count) <= limit)
    flagged = rows.join(F.broadcast(heavy.select(key).withColumn("_heavy", F.lit(True))), key, "left")
    a = flagged.where(F.col("_heavy")).drop("_heavy").join(F.broadcast(heavy), key)
    b = flagged.where(F.col("_heavy").isNull()).drop("_heavy").join(light, key, how)
    return a.unionByName(b)


def reads_files(docs: DataFrame) -> bool:
    """Whether docs is files' rows, at most filtered and with columns of each row, so that a file and row number name a row."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns as _c0, _c1 and so on, and _file and _row, which name a row for good; tables that aren't read from files are written first."""
    every = [f"_c{k}" for k in range(len(docs.columns))]
    at = [every[docs.columns.index(c)] for c in columns]
    own = docs.toDF(*every)
    try:
        if reads_files(own):
            meta = own.metadataColumn("_metadata")
            return own.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(at)], meta["file_path"].alias("_file"), meta["row_index"].alias("_row"))
    except AnalysisException:  # a format without row numbers
        pass
    rows = written(own.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(at)]), "rows")
    return located(rows, *rows.columns)


#: Words of 64 bits in the filter of sifted().
FILTER_WORDS = 1 << 18


def screened(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """rows with _maybe, which is true wherever `wanted` has a partner by `columns`, and false for most others.

    The filter is a table of at most FILTER_WORDS numbers of 64 bits, so it can be
    broadcast whatever the size of `wanted`; the more rows that has, the more are true.
    """
    place = F.xxhash64(*columns)
    word, bit = F.shiftrightunsigned(place, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)), place.bitwiseAND(F.lit(63)).cast("int")
    one = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    bits = one.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    hit = F.call_function("getbit", F.coalesce("_bits", F.lit(0).cast("long")), bit) == 1
    return found.withColumn("_maybe", hit).drop("_word", "_bits")


def sifted(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """rows without most of those that have no partner in `wanted` by `columns`, before a join shuffles them."""
    return screened(rows, wanted, columns).where("_maybe").drop("_maybe")
