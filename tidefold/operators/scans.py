"""Running sums and ordered folds by key, also where one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.sources.shared import broadcast_if_few, keep

#: Rows of one key that a plain window sorts in one task at most.
HOT_ROWS = 5_000_000
#: Rows of (key, range) that are sent to all tasks at most.
BROADCAST_RANGES = 200_000


def hottest(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has the most."""
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], minima: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """`rows` with the running sums, and the running minima of columns, of each key in order of `order`, which is unique
    within a key.

    One window by key where no key has more than HOT_ROWS rows, counted here unless `most` says it. Else rows are dealt in ranges of
    (keys, order), whatever the keys' sizes; windows run within ranges, and what earlier ranges of a key add up to is
    carried in from a table of one row per key and range. The results are the same.
    """
    minima = minima or {}
    if (hottest(rows, keys) if most is None else most) <= HOT_ROWS:
        w = Window.partitionBy(*keys).orderBy(order)
        return rows.withColumns({n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.min(c).over(w) for n, c in minima.items()})
    dealt = rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id())
    dealt = keep(dealt.withColumns({f"_{n}": c for n, c in (sums | minima).items()}))
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums], *[F.min(f"_{n}").alias(f"_{n}") for n in minima])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.sum(f"_{n}").over(before).alias(f"_c_{n}") for n in sums], *[F.min(f"_{n}").over(before).alias(f"_c_{n}") for n in minima])
    carried = broadcast_if_few(keep(carried), BROADCAST_RANGES)
    own = Window.partitionBy(*keys, "_range").orderBy(order)
    local = dealt.withColumns({f"_s_{n}": F.sum(f"_{n}").over(own) for n in sums} | {f"_s_{n}": F.min(f"_{n}").over(own) for n in minima})
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    done = local.join(carried, on).withColumns({n: F.col(f"_s_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums} | {n: F.least(f"_s_{n}", f"_c_{n}") for n in minima})
    return done.select(*rows.columns, *sums, *minima)


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """A fold of each key's rows in order: step(state, row) may return a tuple of `schema`, as may end(key, state).

    Rows are sorted by Spark, which spills, and stream through; a task holds one key's state at a time, never a key's rows.
    """
    columns = rows.columns

    def run(frames):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        state, last, seen = None, None, False
        for pdf in frames:
            out = []
            for values in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in columns)):
                row = dict(zip(columns, values))
                if not seen or row[key] != last:
                    if seen and end and (found := end(last, state)) is not None:
                        out.append(found)
                    state, last, seen = start(), row[key], True
                if (found := step(state, row)) is not None:
                    out.append(found)
            if out:
                yield pd.DataFrame(out, columns=names)
        if seen and end and (found := end(last, state)) is not None:
            yield pd.DataFrame([found], columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
