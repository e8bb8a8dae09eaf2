"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
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


#: Folders made so far, by application.
_MADE: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, what: str) -> str:
    folder = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Deletes the folders that new_folder() has named, once nothing reads them any more; how many there were. What
    cut() wrote Spark deletes itself where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in made:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(made)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows, kept in the shared folder: lineage ends there and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written as a Parquet table into the shared folder; smaller there than a checkpoint."""
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """A kept table, sent to all tasks if it has at most so many rows, counted here; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def tidy(run):
    """`run` for mapInArrow, giving memory back when a partition ends: workers live on beside others, and beside the JVM."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
