"""Vector collections: rows (id, vector, metadata columns, payload, expires_at) and their descriptors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.vector import METRICS
from tidefold.operators.oplog import live

MODALITIES = ("vector", "text", "image", "video", "audio", "multimodal")


@dataclass
class Catalog:
    """Descriptors of collections by name; creating one again with the same size and metric changes nothing."""

    entries: dict[str, tuple[int, str, str]] = field(default_factory=dict)

    def create(self, name: str, dimensions: int, metric: str = "cosine", modality: str = "vector") -> tuple[int, str, str]:
        if not name or dimensions <= 0:
            raise ValueError("a collection needs a name and dimensions above 0")
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        if modality not in MODALITIES:
            raise ValueError(f"unknown modality {modality}")
        known = self.entries.setdefault(name, (dimensions, metric, modality))
        if known[:2] != (dimensions, metric):
            raise ValueError(f"{name} exists with {known[0]} dimensions and metric {known[1]}")
        return known

    def check(self, name: str, vectors: DataFrame) -> DataFrame:
        """`vectors`, failing on a row with another number of dimensions."""
        n = self.entries[name][0]
        wrong = F.raise_error(F.concat(F.lit(f"{name} has {n} dimensions, not "), F.size("vector").cast("string")))
        return vectors.withColumn("vector", F.when(F.size("vector") == n, F.col("vector")).otherwise(wrong.cast("array<float>")))

    def frame(self, spark) -> DataFrame:
        rows = [(k, *v) for k, v in sorted(self.entries.items())]
        return spark.createDataFrame(rows, "collection string, dimensions int, metric string, modality string")


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """The collection that the embedding table stands for: every seventh entry has an expiry of its own id."""
    return embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", (F.col("vec_id") % 8).cast("int").alias("bucket"),
        F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("payload"), F.when(F.col("vec_id") % 7 == 0, F.col("vec_id").cast("double")).alias("expires_at"),
    )


def matching(filters: dict) -> Column:
    """Conjunction of equalities; a null value matches a missing one."""
    out = F.lit(True)
    for name, value in filters.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def current(log: DataFrame, keys: tuple[str, ...] = ("collection", "id"), as_of: float | None = None) -> DataFrame:
    """The last upsert of each id that isn't deleted or expired, with since, the lsn of its first upsert since a delete."""
    rest = [c for c in log.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy("lsn")
    gone = F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("lsn"))).over(order), F.lit(-1))
    rows = log.withColumn("gone", gone).where("op = 'upsert'")
    last_delete = log.where("op = 'delete'").groupBy(*keys).agg(F.max("lsn").alias("last_delete"))
    state = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "lsn").alias("s"), F.max("gone").alias("gone"))
    first = rows.groupBy(*keys, "gone").agg(F.min("lsn").alias("since"))
    state = state.join(first, [*keys, "gone"]).join(last_delete, list(keys), "left").where("last_delete IS NULL OR s.lsn > last_delete")
    out = state.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest if c != "op"], "since")
    return out if as_of is None else out.where(live(as_of))


def scan(collection: DataFrame, limit: int = 1000, as_of: float | None = None, include_vectors: bool = False) -> DataFrame:
    """Live rows in order of first insertion (id where that isn't known)."""
    if limit <= 0:
        raise ValueError("limit must be above 0")
    rows = collection if as_of is None else collection.where(live(as_of))
    rows = rows.orderBy("since" if "since" in rows.columns else "id").limit(limit)
    return rows if include_vectors else rows.drop("vector")


def get(collection: DataFrame, id, as_of: float | None = None, include_vector: bool = False) -> DataFrame:
    rows = collection.where(F.col("id") == id)
    rows = rows if as_of is None else rows.where(live(as_of))
    return rows if include_vector else rows.drop("vector")


def list_collections(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """collection, dimensions, metric, vectors: 0 for a collection without rows."""
    n = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return catalog.join(n, "collection", "left").select("collection", "dimensions", "metric", F.coalesce("n", F.lit(0)).cast("long").alias("vectors"))


def collection_stats(rows: DataFrame) -> DataFrame:
    """collection, vectors, with_expiry: a row for each and one for all (collection null)."""
    return rows.rollup("collection").agg(F.count(F.lit(1)).alias("vectors"), F.count("expires_at").alias("with_expiry"))


def compact(log: DataFrame, keys: tuple[str, ...] = ("collection", "id"), as_of: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The upserts that stay, and one row (before, after, reclaimed) of record counts."""
    kept = current(log, keys, as_of)
    after = kept.agg(F.count(F.lit(1)).alias("after"))
    counts = log.agg(F.count(F.lit(1)).alias("before")).select("before", after.scalar().alias("after"))
    return kept, counts.withColumn("reclaimed", F.greatest(F.col("before") - F.col("after"), F.lit(0)))
