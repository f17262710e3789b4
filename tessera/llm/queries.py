"""One query for each training-data operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ann import fiftieths
from .bpe_codec import bpe_codes
from .exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from .language_id import language_id
from .license_scan import license_scan, license_sql
from .line_dedup import LINE_DEDUP_SQL, line_dedup
from .mixing import MIXED_SQL, mixed
from .quality import quality_scores
from .shared import documents
from .simhash import simhash_dedup
from .token_counts import token_counts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fiftieths(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codes(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_line_dedup, op3_ann, op4_language_id, op5_token_counts, op6_simhash, op7_bpe_codec, op8_exact_dedup, op9_quality, op10_mixing)
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op2_line_dedup": LINE_DEDUP_SQL,
    "op8_exact_dedup": EXACT_DEDUP_SQL,
    "op10_mixing": MIXED_SQL,
}
