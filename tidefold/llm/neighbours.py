"""Nearest neighbours by a block matrix join of int8 tiles.

Candidates and queries are packed into tiles of at most TILE vectors, each with int8 codes, a scale and the exact
length of every vector's quantisation residual. Tiles meet on a grid: query panels are repeated over the grid's
columns and candidate tiles over its rows, so each task holds one query tile and one candidate tile at a time and no
side is broadcast. An integer matrix product gives each tile pair's distances; by the triangle inequality they are off
by at most the two residuals, so a candidate whose lower bound exceeds a query's k-th smallest upper bound is out. The
others are recomputed in double precision and kept in heaps of k, and the heaps of all tiles merge by query.
The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import cut, partitions, table, tidy

TILE = 2048
PANEL = 2048
TILE_SCHEMA = "dim int, tile long, n int, ids binary, vectors binary, codes binary, scale double, residuals binary"


def quantise(v: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 codes, their scale, and the length of what is left of each row."""
    scale = float(np.abs(v).max()) / 127 or 1.0
    if not np.isfinite(1 / scale):  # denormal vectors
        return np.zeros(v.shape, np.int8), 1.0, np.sqrt((v * v).sum(1)) + np.abs(v).max()
    codes = np.clip(np.rint(v / scale), -127, 127).astype(np.int8)
    rest = v - codes * scale
    return codes, scale, np.sqrt((rest * rest).sum(1))


def valid_rows(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the ids and vectors that take part."""
    ids, lists = batch.column(0), batch.column(1)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ok = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    offsets = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    keys, out = np.asarray(ids.fill_null(0)), {}
    lengths = np.diff(offsets)
    for dim in np.unique(lengths[ok & (lengths > 0)]).tolist():
        rows = np.flatnonzero(ok & (lengths == dim))
        v = flat[offsets[rows][:, None] + np.arange(dim)]
        good = np.isfinite(v).all(1) & (v != 0).any(1)
        out[dim] = keys[rows[good]].astype(np.int64), v[good]
    return out


def pack_tiles(vectors: DataFrame, rows: int = TILE) -> DataFrame:
    """Tiles of (id, vector) rows. Rows with a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component, are in none."""

    def pack(batches):
        held: dict[int, list] = {}
        base, made = TaskContext.get().partitionId() << 32, 0

        def tile(dim, ids, v):
            nonlocal made
            codes, scale, rest = quantise(v)
            made += 1
            one = [[dim], [base + made], [len(ids)], [ids.tobytes()], [v.tobytes()], [codes.tobytes()], [scale], [rest.tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds)], names=[x.split()[0] for x in TILE_SCHEMA.split(", ")])

        for batch in batches:
            for dim, (ids, v) in valid_rows(batch).items():
                a, b = held.pop(dim, (ids[:0], v[:0]))
                ids, v = np.concatenate([a, ids]), np.concatenate([b, v])
                while len(ids) >= rows:
                    yield tile(dim, ids[:rows], v[:rows])
                    ids, v = ids[rows:], v[rows:]
                held[dim] = ids, v
        for dim, (ids, v) in held.items():
            if len(ids):
                yield tile(dim, ids, v)

    return vectors.mapInArrow(tidy(pack), TILE_SCHEMA)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows' pairs, summed in order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def join_tiles(k: int):
    def run(batches):
        queries: dict = {}  # by query tile: its arrays and a heap of (-distance, -id) for each of its rows

        def unpack(c, p, i, dim):
            ids = np.frombuffer(c[f"{p}_ids"][i].as_py(), np.int64)
            v = np.frombuffer(c[f"{p}_vectors"][i].as_py(), np.float64).reshape(-1, dim)
            codes = np.frombuffer(c[f"{p}_codes"][i].as_py(), np.int8).reshape(-1, dim).astype(np.float32 if dim <= 1024 else np.float64)
            return ids, v, codes, c[f"{p}_scale"][i].as_py(), np.frombuffer(c[f"{p}_residuals"][i].as_py(), np.float64)

        for batch in batches:
            c = {name: batch.column(j) for j, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                dim, key = c["dim"][i].as_py(), c["q_tile"][i].as_py()
                if key not in queries:
                    queries[key] = (*unpack(c, "q", i, dim), [])
                    queries[key][-1].extend([] for _ in range(len(queries[key][0])))
                qid, qv, qc, qs, qr, heaps = queries[key]
                cid, cv, cc, cs, cr = unpack(c, "c", i, dim)
                square = (qs * qs) * (qc.astype(np.float64) ** 2).sum(1)[:, None] + (cs * cs) * (cc.astype(np.float64) ** 2).sum(1)[None, :]
                middle = np.sqrt(np.maximum(square - (2 * qs * cs) * (qc @ cc.T).astype(np.float64), 0))
                off = (qr[:, None] + cr[None, :]) * (1 + 1e-9) + 1e-9 * np.sqrt(square) + 1e-300
                lower, upper = middle - off, middle + off
                own = qid[:, None] == cid[None, :]
                lower[own] = upper[own] = np.inf
                limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(cid) >= k else np.full(len(qid), np.inf)
                known = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps])
                a, b = np.nonzero((lower <= np.minimum(limit, known)[:, None]) & ~own)
                for s in range(0, len(a), 1 << 18):
                    x, y = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
                    for q, d, other in zip(x.tolist(), exact_distances(qv[x], cv[y]).tolist(), cid[y].tolist()):
                        h, item = heaps[q], (-d, -other)
                        if len(h) < k:
                            heapq.heappush(h, item)
                        elif item > h[0]:
                            heapq.heapreplace(h, item)
        for key, (qid, *_, heaps) in queries.items():
            rows = [(key, q, int(qid[q]), -other, -d) for q, h in enumerate(heaps) for d, other in h]
            if rows:
                t, q, i, v, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names=["tile", "row", "query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` for each row of `queries`, both (id, vector).

    Score is the Euclidean distance in double precision; ties go to the smaller id. Rows with a query's own id are not
    its candidates. See pack_tiles() for rows that take no part; vectors meet only those of their own dimension;
    repeated query rows are each answered; a vec_id on several rows is found as often. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    slots = max(2, partitions(spark))
    panels = max(1, -(-queries.count() // PANEL))
    ready = lambda df: df.select(F.col(df.columns[0]).cast("long").alias("id"), F.col(df.columns[1]).cast("array<double>").alias("v"))
    q = pack_tiles(ready(queries).repartition(panels, "id"), PANEL)
    q = cut(q.withColumn("panel", F.pmod(F.xxhash64("tile"), F.lit(panels))))
    q = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    c = pack_tiles(ready(vectors)).withColumn("slot", F.pmod(F.xxhash64("tile"), F.lit(slots)).cast("int"))
    c = c.withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels - 1))))
    c = c.withColumn("panel", F.col("panel").cast("long"))
    on, names = ["dim", "panel", "slot"], ["tile", "ids", "vectors", "codes", "scale", "residuals"]
    side = lambda df, p: df.select(*on, *[F.col(x).alias(f"{p}_{x}") for x in names])
    pairs = side(c, "c").join(side(q, "q"), on)
    found = pairs.mapInArrow(tidy(join_tiles(k)), "tile long, row int, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("tile", "row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.where("vec_id % 100 = 0"), 10)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
