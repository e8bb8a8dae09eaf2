"""FIFO queues. A queue's depth is a walk reflected at zero: s minus its running minimum, where s counts enqueues less
dequeues. So depths, and which enqueue each dequeue takes, follow from windows and one equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.scans import hottest, running


def walk(log: DataFrame) -> DataFrame:
    """lsn, queue, op, value, depth after each command, enq_n and deq_n: enqueues and successful dequeues so far."""
    rows = log.where("op IN ('enqueue', 'dequeue')").select("lsn", "queue", "op", "value")
    enqueue, most = F.col("op") == "enqueue", hottest(rows, ["queue"])
    rows = running(rows, ["queue"], "lsn", {"s": F.when(enqueue, 1).otherwise(-1), "enq_n": F.when(enqueue, 1).otherwise(0)}, most=most)
    rows = running(rows, ["queue"], "lsn", {}, {"low": F.col("s")}, most=most)
    rows = rows.withColumn("depth", F.col("s") - F.least(F.lit(0), "low"))
    return rows.withColumn("deq_n", F.col("enq_n") - F.col("depth")).drop("s", "low")


def dequeues(log: DataFrame) -> DataFrame:
    """lsn, queue, value: what each dequeue returns, null from an empty queue."""
    # the first command that has taken so many is the one that took the last of them
    w = walk(log)
    took = w.where("op = 'dequeue' AND deq_n > 0").groupBy("queue", F.col("deq_n").alias("n")).agg(F.min("lsn").alias("lsn"))
    given = w.where("op = 'enqueue'").select("queue", F.col("enq_n").alias("n"), F.col("value").alias("given"))
    filled = took.join(given, ["queue", "n"]).select("lsn", "queue", "given")
    return log.where("op = 'dequeue'").select("lsn", "queue").join(filled, ["lsn", "queue"], "left").select("lsn", "queue", F.col("given").alias("value"))


def depths(log: DataFrame) -> DataFrame:
    """queue, depth at the end. The running minimum needs each queue's order; the last row has the answer."""
    return walk(log).groupBy("queue").agg(F.max_by("depth", "lsn").alias("depth"))


def remaining(log: DataFrame) -> DataFrame:
    """queue, place, value: what is still queued, oldest first."""
    w = walk(log)
    done = w.groupBy("queue").agg(F.max("deq_n").alias("done"))
    left = w.where("op = 'enqueue'").join(done, "queue").where("enq_n > done")
    return left.select("queue", (F.col("enq_n") - F.col("done")).alias("place"), "value")
