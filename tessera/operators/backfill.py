"""Stages of a long job, each with a marker when it has ended, and versions of the tables' schemas."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import files


@dataclass
class Stage:
    name: str
    run: Callable[[], None]
    ready: Callable[[], bool] = lambda: True  # what it waits for, such as an empty queue


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def is_done(spark: SparkSession, root: str, name: str) -> bool:
    system, path = _path(spark, f"{root}/{name}.done")
    return system.exists(path)


def run_stages(spark: SparkSession, root: str, stages: list[Stage], poll: float = 60.0, patience: float = float("inf")) -> list[str]:
    """Run stages in turn and return the names of those that ran.

    A stage waits until it's ready (`patience` seconds at most, then TimeoutError) and
    leaves a marker after its end, so a job that is started again goes on with the first
    stage that hasn't ended.  A stage may therefore run twice, and has to bear that.
    """
    ran = []
    for stage in stages:
        if is_done(spark, root, stage.name):
            continue
        waited = 0.0
        while not stage.ready():
            if waited >= patience:
                raise TimeoutError(f"{stage.name} did not become ready")
            time.sleep(poll)
            waited += poll
        stage.run()
        system, path = _path(spark, f"{root}/{stage.name}.done")
        system.create(path, True).close()
        ran.append(stage.name)
    return ran


#: Versions of the tables, in order: each creates or widens some.
MIGRATIONS = [
    ("0001_documents_and_chunks", {"documents": files.DOCUMENT, "chunks": files.CHUNK}),
    ("0002_vectors", {"chunk_vectors": files.CHUNK_VECTOR}),
    ("0003_queues", {"jobs": files.JOB, "outbox": files.OUTBOX, "tombstones": files.TOMBSTONE}),
]


def migrate(spark: SparkSession, root: str, migrations: list[tuple[str, dict[str, str]]] = MIGRATIONS) -> list[str]:
    """Bring the tables below root to the last version; returns what was applied.

    A new table starts empty; one that exists is written anew with the columns that it
    lacks as nulls, as a version beside the old one, before the marker says that it counts.
    """

    def apply(name: str, tables: dict[str, str]) -> None:
        for table, schema in tables.items():
            wanted = spark.createDataFrame([], schema)
            before = current(spark, root, table, migrations)
            rows = wanted if before is None else before.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema if f.name not in before.columns])
            rows.write.mode("overwrite").parquet(f"{root}/{table}/version={name}")

    return run_stages(spark, f"{root}/_migrations", [Stage(n, lambda n=n, t=t: apply(n, t)) for n, t in migrations])


def current(spark: SparkSession, root: str, table: str, migrations: list[tuple[str, dict[str, str]]] = MIGRATIONS):
    """The newest version of a table that counts, None if there is none."""
    found = [n for n, tables in migrations if table in tables and is_done(spark, f"{root}/_migrations", n)]
    return spark.read.parquet(f"{root}/{table}/version={found[-1]}") if found else None
