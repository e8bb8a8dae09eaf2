"""Event streams with a sequence number for each stream, from 1, restarting after a flush."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators.scans import running


def sequenced(log: DataFrame) -> DataFrame:
    """lsn, stream, seq, event. With an epoch column, sequences restart in each epoch."""
    keys = ["epoch", "stream"] if "epoch" in log.columns else ["stream"]
    rows = log.where("op = 'append_event'").select("lsn", *keys, F.col("value").alias("event"))
    rows = running(rows, keys, "lsn", {"seq": F.lit(1)})
    return rows.select("lsn", *keys, F.col("seq").cast("long").alias("seq"), "event")


def ids(sequence: DataFrame, log: DataFrame) -> DataFrame:
    """lsn, stream, id: the id of each event, its milliseconds and its sequence number."""
    ms = F.floor(F.col("ts") * 1000).cast("long").cast("string")
    return sequence.join(log.select("lsn", "ts"), "lsn").select("lsn", "stream", F.concat_ws("-", ms, F.col("seq").cast("string")).alias("id"))


def read_after(streams: DataFrame, stream: str, after_seq: int = 0, limit: int = 100) -> DataFrame:
    """The first `limit` events after a sequence number, in order; none of an unknown stream."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return streams.where((F.col("stream") == stream) & (F.col("seq") > after_seq)).orderBy("seq").limit(limit)


def read_range(streams: DataFrame, stream: str, first: int, last: int, count: int = 100, reverse: bool = False) -> DataFrame:
    """Events with first <= seq <= last, the earliest `count` of them or, reversed, the latest."""
    inside = streams.where((F.col("stream") == stream) & F.col("seq").between(first, last))
    return inside.orderBy(F.col("seq").desc() if reverse else F.col("seq")).limit(count)


def read_many(streams: DataFrame, cursors: DataFrame, count: int) -> DataFrame:
    """The first `count` events after each of `cursors` (stream, after_seq)."""
    rows = streams.join(cursors, "stream").where("seq > after_seq")
    place = F.row_number().over(Window.partitionBy("stream").orderBy("seq"))
    return rows.withColumn("place", place).where(F.col("place") <= count).select("stream", "seq", "event")


def lengths(streams: DataFrame) -> DataFrame:
    """stream, n, last_seq."""
    return streams.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
