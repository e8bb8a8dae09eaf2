"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node with a link to another node, the smallest node it can reach.

    `links`: two columns of nodes, in either order, repeats and loops allowed; rows with a null are no links. Each
    round hangs every node's neighbours on the smallest one, first the larger neighbours and then the smaller; all
    steps are aggregations and joins of narrow rows, and each round ends in the shared folder. Ends when a round
    changes nothing, after about as many rounds as the logarithm of the longest path.
    """
    a, b = links.columns
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = mark(e)
    for _ in range(rounds):
        if not last[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionAll(down.select("a", F.col("m").alias("b"))).distinct())
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
