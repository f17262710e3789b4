"""Tables that are written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset a session on one machine gets a folder of its own; on a cluster such
    a folder can't take its place, so there that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written() tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera/" in folder:
                delete(df.sparkSession, folder)


def signature(df: DataFrame) -> tuple:
    """What tells whether a table's files are the same as before: their paths, sizes and times."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        found += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in path.getFileSystem(conf).listStatus(path)]
    return tuple(sorted(found))


def ranged(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows, written in ranges of the keys, and _part, the number of the range: a global order in which no task holds more than its range."""
    return written(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), label)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 0 on, in the order of the keys, whatever share of the rows one key holds."""
    own = ranged(rows, keys, "numbered")
    counts = own.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return own.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")
