"""Rate limits over (key, ts) calls."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.text import fixed_window
from tidefold.operators.scans import folded


def fixed(calls: DataFrame, width: int, most: int) -> DataFrame:
    """bucket, allowed, remaining for each call, in order of (ts, id)."""
    rows = calls.withColumn("bucket", fixed_window(F.col("ts"), width))
    n = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("ts", "id"))
    return rows.withColumn("n", n).select("id", "key", "bucket", (F.col("n") <= most).alias("allowed"), F.greatest(F.lit(most) - F.col("n"), F.lit(0)).alias("remaining"))


def sliding(calls: DataFrame, width: float, most: int) -> DataFrame:
    """id, key, allowed. Rejected calls don't count, so each key's calls are folded in order."""

    def step(held: deque, r: dict):
        while held and held[0] <= r["ts"] - width:
            held.popleft()
        ok = len(held) < most
        if ok:
            held.append(r["ts"])
        return r["id"], r["key"], ok

    return folded(calls.select("id", "key", "ts"), "key", ["ts", "id"], deque, step, "id long, key string, allowed boolean")
