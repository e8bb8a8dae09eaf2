"""Versions of vectors: history, as-of search and drift, over rows (id, version, ts, vector)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.vector import cosine, literal

def order():
    return Window.partitionBy("id").orderBy("version")


def versions_from(embeddings: DataFrame) -> DataFrame:
    """100 ids with a version for each hundred of vec_id."""
    return embeddings.select((F.col("vec_id") % 100).alias("id"), F.floor(F.col("vec_id") / 100).cast("long").alias("version"), F.col("vec_id").alias("ts"), F.col("embedding").alias("vector"))


def validity(versions: DataFrame) -> DataFrame:
    """With valid_from and valid_to (null: current)."""
    return versions.withColumn("valid_from", F.col("ts")).withColumn("valid_to", F.lead("ts").over(order()))


def history(versions: DataFrame, id, limit: int = 100) -> DataFrame:
    """version, ts, current: the last `limit` superseded versions, whose ts is when they were replaced, and the current."""
    rows = validity(versions.where(F.col("id") == id)).withColumn("current", F.col("valid_to").isNull())
    back = F.row_number().over(Window.partitionBy("id").orderBy(F.col("version").desc()))
    return rows.withColumn("back", back).where(F.col("back") <= limit + 1).select("version", F.coalesce("valid_to", "ts").alias("ts"), "current")


def _top(rows: DataFrame, vector, k: int) -> DataFrame:
    return rows.withColumn("score", cosine(F.col("vector"), literal(vector))).orderBy(F.col("score").desc(), "id").limit(k).select("id", "version", "score")


def query_as_of(versions: DataFrame, vector, as_of, k: int) -> DataFrame:
    """The best of the versions that were valid at as_of."""
    rows = validity(versions).where((F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of)))
    return _top(rows, vector, k)


def query_as_of_replaced(versions: DataFrame, vector, as_of, k: int) -> DataFrame:
    """The best by replacement time: of an id with history the last version replaced by as_of (none: the id is left
    out), of an id without history its only version at any time."""
    rows = validity(versions)
    old = rows.where(F.col("valid_to") <= as_of).groupBy("id").agg(F.max_by(F.struct("version", "vector"), "version").alias("v")).select("id", "v.version", "v.vector")
    single = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("version"), F.max_by("vector", "version").alias("vector")).where("n = 1").select("id", "version", "vector")
    return _top(old.unionByName(single), vector, k)


def drift(versions: DataFrame, include_current: bool = False) -> DataFrame:
    """id, drift, versions: the sum of 1 - cosine between consecutive versions, each rounded to 6 places; the current
    one takes no part unless asked for."""
    rows = validity(versions)
    rows = rows if include_current else rows.where(F.col("valid_to").isNotNull() | F.lit(False))
    step = F.round(1 - cosine(F.lag("vector").over(order()), F.col("vector")), 6)
    steps = rows.withColumn("step", F.when(F.lag("vector").over(order()).isNotNull(), step))
    out = steps.groupBy("id").agg(F.round(F.sum(F.coalesce("step", F.lit(0.0))), 6).alias("drift"), F.count(F.lit(1)).alias("n"))
    return out.select("id", "drift", (F.when(F.col("n") < 2, F.col("n")).otherwise(F.col("n") + (0 if include_current else 1))).alias("versions"))
