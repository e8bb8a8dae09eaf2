"""Tables that end a lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made so far, by application.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidefold-")
        sc.setCheckpointDir(where)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, what: str) -> str:
    folder = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def keep(df: DataFrame, by: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """The same rows from a Parquet table, partitioned by the columns `by`; in `folder`, or a new one."""
    folder = folder or new_folder(df.sparkSession, "table")
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(*df.columns)


def release(spark: SparkSession) -> int:
    """Deletes the folders that new_folder() has named, once nothing reads them any more; how many there were."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in made:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(made)


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """A kept table, sent to all tasks if it has at most so many rows, counted here; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
