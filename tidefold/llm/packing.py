"""Packing into optimal length buckets.

The histogram of lengths is aggregated over all documents; dynamic programming over it chooses the bucket boundaries
with the least padding in all; batches within a token budget form inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import cut, table, word_count

#: Documents of a bucket are dealt over shards of about this many rows, each of which ends in at most one part-full batch.
SHARD_ROWS = 65536


def optimal_boundaries(histogram: list[tuple[int, int]], n_buckets: int) -> tuple[list[int], int]:
    """The at most n_buckets largest lengths of buckets with the least padding, and that padding.

    Exact for the histogram, in O(buckets * cells): the layers' minima are lower envelopes of lines, since padding up
    to cell j from after cell i is length[j] * (count[j] - count[i]) - (sum[j] - sum[i]) in prefix sums.
    """
    cells = sorted(histogram)
    if not cells:
        return [], 0
    n = len(cells)
    count, total = [0], [0]
    for length, k in cells:
        count.append(count[-1] + k)
        total.append(total[-1] + k * length)
    best = [0 if j == 0 else None for j in range(n + 1)]  # exactly k buckets over the first j cells
    layers, result = [], None
    for _ in range(min(n_buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, intercept, i; slopes fall with i
        now: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                new = (-count[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(lines) > 1 and (new[1] - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - new[0]):
                    lines.pop()
                lines.append(new)
                at = min(at, len(lines) - 1)
            if lines:
                length = cells[j - 1][0]
                while at + 1 < len(lines) and lines[at + 1][0] * length + lines[at + 1][1] <= lines[at][0] * length + lines[at][1]:
                    at += 1
                now[j] = length * count[j] - total[j] + lines[at][0] * length + lines[at][1]
                back[j] = lines[at][2]
        layers.append(back)
        best = now
        if result is None or now[n] < result[1]:
            result = (len(layers), now[n])
    bounds, j = [], n
    for k in range(result[0] - 1, -1, -1):
        bounds.append(cells[j - 1][0])
        j = layers[k][j]
    return bounds[::-1], result[1]


def pack_documents(docs: DataFrame, n_buckets: int = 16, token_budget: int = 65536, length=None) -> DataFrame:
    """doc_id, length, bucket, padded_length, shard, batch, padding: one row per row of `docs`.

    `length`: a column of token counts; else the words of `text`. A batch is (bucket, shard, batch); its rows times
    the bucket's padded length stay within token_budget, but a document longer than that is a batch by itself. Boundaries
    have the least padding for any lengths: k distinct lengths add up to k * k / 2 tokens or more, so the histogram that
    the driver works on has at most as many rows as the square root of twice all tokens. Null and
    empty texts have length 0 and go to the shortest bucket; null ids are packed like others; repeated rows are packed
    once each; an empty table gives an empty result.
    """
    sized = docs.select("doc_id", (word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("length"))
    sized = cut(sized)
    histogram = [(r[0], r[1]) for r in sized.groupBy("length").count().collect()]
    bounds, _ = optimal_boundaries(histogram, n_buckets)
    if not bounds:
        return sized.selectExpr("doc_id", "length", "0 AS bucket", "0L AS padded_length", "0L AS shard", "0L AS batch", "0L AS padding").limit(0)
    rows = [sum(k for c, k in histogram if lo < c <= hi) for lo, hi in zip([-1, *bounds[:-1]], bounds)]
    per = [max(1, token_budget // max(1, b)) for b in bounds]
    shards = [max(1, round(n / SHARD_ROWS)) for n in rows]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = sum((F.col("length") > F.lit(b)).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    out = sized.withColumn("bucket", bucket).withColumn("padded_length", pick(bounds))
    out = out.withColumn("order", F.xxhash64("doc_id", "length")).withColumn("shard", F.pmod("order", pick(shards)))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("order", "doc_id")) - 1
    out = out.withColumn("batch", F.floor(place / pick(per)))
    return out.select("doc_id", "length", "bucket", "padded_length", "shard", "batch", (F.col("padded_length") - F.col("length")).alias("padding"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
