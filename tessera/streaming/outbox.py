"""Index synchronisation as a stream: a batch of operations, one new version of the index.

A version is a folder; a batch's version is written before the next batch starts, and a
batch that is run again after a failure writes the same version again, so operations
that are delivered twice have no second effect.  Readers pin a version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import drained
from ..operators.monitoring import sliding

OPERATIONS = "seq long, id long, op string, value double"
INDEX = "id long, value double"


def version_path(root: str, batch: int) -> str:
    return f"{root}/version={batch:012d}"


def read_version(spark: SparkSession, root: str, batch: int, schema: str = INDEX) -> DataFrame:
    """The index after a batch; before the first one it is empty."""
    return spark.createDataFrame([], schema) if batch < 0 else spark.read.schema(schema).parquet(version_path(root, batch))


def synchronise(operations: DataFrame, root: str, checkpoint: str, once: bool = True, poll: str = "2 seconds") -> int:
    """Apply a stream of operations; with once=True until all that is there has been applied.

    Returns the last batch's number, -1 if there was none.  Rows that can't be applied (no
    id, or an unknown operation) go to root/poison with their batch.
    """
    last = [-1]

    def apply(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        good = F.col("id").isNotNull() & F.col("op").isin("upsert", "delete")
        batch_df.where(~F.coalesce(good, F.lit(False))).write.mode("overwrite").parquet(f"{root}/poison/batch={batch}")
        drained(read_version(spark, root, batch - 1), batch_df.where(good), "id").write.mode("overwrite").parquet(version_path(root, batch))
        last[0] = batch

    writer = operations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()
    if once:
        query.awaitTermination()
    return last[0]


def rates(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by type and sliding window of a stream of events; the watermark only bounds the state."""
    return sliding(events, "ts", ["event_type"], width, slide, F.count("*").alias("n"), late=late)


ATTEMPTS = "id long, attempts int, status string"


def attempts(failures: DataFrame, most: int = 10) -> DataFrame:
    """Running numbers of failures by id, and failed once there are `most`: state is kept for each id without expiry."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"id": [key[0]], "attempts": [n], "status": ["failed" if n >= most else "pending"]})

    return failures.groupBy("id").applyInPandasWithState(count, ATTEMPTS, "n int", "update", "NoTimeout")
