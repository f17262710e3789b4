"""Answers from contexts: an interface, without a generator of its own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .breaker import CircuitBreaker
from .search import prompt


def retried(call: Callable, attempts: int = 3, wait: float = 0.5) -> Callable:
    """The function, tried again after a wait that doubles each time; the last failure is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(wait * 2**k)

    return run


def answers(contexts: DataFrame, generate: Callable[[str], str | Iterable[str]] | None = None, attempts: int = 3, wait: float = 0.5, threshold: int = 5) -> DataFrame:
    """query_id and answer from query_id, question and context_text.

    Without a generator, or without evidence (an empty or missing context), the answer is
    null and the generator isn't called.  The generator gives a text or its pieces one
    after another; it's tried again when it fails, and a worker's breaker stops calls
    after `threshold` questions have failed in a row: their answers are null.
    """
    if generate is None:
        return contexts.select("query_id", F.lit(None).cast("string").alias("answer"))

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        breaker, ask = CircuitBreaker(threshold), retried(lambda p: "".join(generate(p)), attempts, wait)

        def answer(text: str | None) -> str | None:
            try:
                return None if text is None else breaker.call(ask, text)
            except Exception:  # the service's own failures, or CircuitOpen: the other questions go on
                return None

        for questions, texts in batches:
            yield pd.Series([answer(prompt(q, c or "")) for q, c in zip(questions, texts, strict=True)], dtype=object)

    return contexts.select("query_id", run("question", "context_text").alias("answer"))


def read_results(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The results of one run, or of all."""
    rows = spark.read.parquet(path)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def append_results(results: DataFrame, path: str, run_id: str, config: str) -> None:
    """Adds an evaluation's results to the table of all runs."""
    results.withColumns({"run_id": F.lit(run_id), "config_name": F.lit(config)}).write.mode("append").partitionBy("run_id").parquet(path)
