"""The operation log, of which all state is a fold.

One row per command: lsn (total order), ts (epoch seconds), op, key, queue, stream, amount, value, expires_at.
Ops: put, incr, delete, enqueue, dequeue, append_event, flushall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.text import epoch_seconds

SCHEMA = "lsn long, ts double, op string, key string, queue string, stream string, amount long, value string, expires_at double"


def from_events(events: DataFrame, ttl_seconds: int = 86400) -> DataFrame:
    """The log that an event table stands for: signups put their props under the user's key, every third of them with
    a time to live; purchases add to the user's counter; views append to one of 8 streams; clicks enqueue and odd
    errors dequeue on one of 8 queues; even errors delete the user's key."""
    op = (
        F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "purchase", "incr").when(F.col("event_type") == "view", "append_event")
        .when(F.col("event_type") == "click", "enqueue").when(F.col("event_id") % 2 == 0, "delete").otherwise("dequeue")
    )
    ts = epoch_seconds(F.col("ts"))
    lane = (F.col("user_id") % 8).cast("string")
    return events.select(
        F.col("event_id").alias("lsn"), ts.alias("ts"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.concat(F.lit("q"), lane).alias("queue"), F.concat(F.lit("s"), lane).alias("stream"), F.floor("value").cast("long").alias("amount"),
        F.col("props").alias("value"), F.when(F.col("event_id") % 3 == 0, ts + ttl_seconds).alias("expires_at"),
    )


def with_epochs(log: DataFrame, flushes: DataFrame) -> DataFrame:
    """`log` with epoch: the number of `flushes` (lsn) before each row.

    Flushes are few (an operator's command): they are numbered by themselves and met by a range join whose broadcast
    side Spark sizes; no window over the whole log is made.
    """
    order = Window.orderBy("flush_lsn")
    spans = flushes.select(F.col("lsn").alias("flush_lsn")).unionAll(flushes.sparkSession.createDataFrame([(-(1 << 62),)], "flush_lsn long"))
    spans = spans.select("flush_lsn", F.lead("flush_lsn").over(order).alias("next_flush"), (F.row_number().over(order) - 1).cast("long").alias("epoch"))
    inside = (F.col("lsn") >= F.col("flush_lsn")) & (F.col("next_flush").isNull() | (F.col("lsn") < F.col("next_flush")))
    return log.join(spans, inside).drop("flush_lsn", "next_flush")


def after_last_flush(log: DataFrame) -> DataFrame:
    """What a flushall leaves: the rows after the last one. One aggregate and a filter."""
    last = log.where("op = 'flushall'").agg(F.coalesce(F.max("lsn"), F.lit(-(1 << 62))).alias("last_flush"))
    return log.where(F.col("lsn") > last.scalar())


def live(as_of: float, expires_at: Column | None = None) -> Column:
    """An entry is gone once its expiry is reached."""
    e = F.col("expires_at") if expires_at is None else expires_at
    return e.isNull() | (e > F.lit(as_of))
