"""Queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions import udfs
from tidefold.operators import ann, collections, search, temporal

QUERIES: dict = {}
SQL: dict[str, str] = {}
TEXT = "the item 17 of the collection"

BASE = """
WITH col AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label, (vec_id % 8)::INTEGER AS bucket, 'item ' || vec_id AS payload, CASE WHEN vec_id % 7 = 0 THEN vec_id::DOUBLE END AS expires_at
  FROM embeddings),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = BASE + sql
        return f

    return add


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def collection(spark, d):
    return collections.from_embeddings(embeddings(spark, d))


def the_vector(spark, d, i: int = 0):
    return embeddings(spark, d).where(F.col("vec_id") == i).select("embedding").first()[0]


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("SELECT id, round(list_cosine_similarity(vector, v), 6) AS score FROM col, q ORDER BY list_cosine_similarity(vector, v) DESC, id LIMIT 10")
def vector_exact_topk(spark, d):
    return rounded(search.exact(collection(spark, d), the_vector(spark, d), 10)).select("id", "score")


@query("SELECT id, bucket, payload, round(list_cosine_similarity(vector, v), 6) AS score FROM col, q WHERE bucket = 3 AND (expires_at IS NULL OR expires_at > 100) ORDER BY list_cosine_similarity(vector, v) DESC, id LIMIT 10")
def vector_filtered_topk(spark, d):
    return rounded(search.exact(collection(spark, d), the_vector(spark, d), 10, filters={"bucket": 3}, as_of=100.0)).select("id", "bucket", "payload", "score")


@query("SELECT id, round(list_dot_product(vector, v), 6) AS score FROM col, q ORDER BY list_dot_product(vector, v) DESC, id LIMIT 10")
def vector_dot_topk(spark, d):
    return rounded(search.exact(collection(spark, d), the_vector(spark, d), 10, "dot")).select("id", "score")


@query("SELECT id, round(0 - power(list_distance(vector, v), 2), 6) + 0.0 AS score FROM col, q ORDER BY list_distance(vector, v), id LIMIT 10")
def vector_l2_topk(spark, d):
    return rounded(search.exact(collection(spark, d), the_vector(spark, d), 10, "l2")).select("id", (F.col("score") + F.lit(0.0)).alias("score"))


KNN = """
, s AS (SELECT c.vec_id AS qid, col.id, list_cosine_similarity(col.vector, c.embedding::DOUBLE[]) AS s FROM embeddings c, col WHERE c.vec_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id)::INTEGER AS rank FROM s)
SELECT qid, rank, id, round(s, 6) AS score FROM r WHERE rank <= 10"""


def tenth(spark, d):
    return embeddings(spark, d).where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


@query(KNN)
def vector_batch_knn(spark, d):
    return rounded(search.batch(collection(spark, d), tenth(spark, d), 10))


@query(KNN)
def vector_batch_knn_sql(spark, d):
    return rounded(search.batch_sql(collection(spark, d), tenth(spark, d), 10))


@query("SELECT id, label, bucket, payload, expires_at FROM col WHERE expires_at IS NULL OR expires_at > 100 ORDER BY id LIMIT 200")
def vector_scan(spark, d):
    return collections.scan(collection(spark, d), 200, as_of=100.0)


@query("SELECT id, label, bucket, payload, expires_at FROM col WHERE id = 42")
def vector_get(spark, d):
    return collections.get(collection(spark, d), 42)


@query("SELECT count(*)::BIGINT AS n FROM col WHERE expires_at IS NULL OR expires_at > 100")
def vector_count(spark, d):
    return search.candidates(collection(spark, d), as_of=100.0).agg(F.count(F.lit(1)).alias("n"))


LOG = """
, log AS (
  SELECT vec_id AS lsn, 'c' || vec_id % 3 AS collection, vec_id % 40 AS id, CASE WHEN vec_id % 11 = 0 THEN 'delete' ELSE 'upsert' END AS op, label, CASE WHEN vec_id % 7 = 0 THEN vec_id::DOUBLE END AS expires_at FROM embeddings),
g AS (SELECT *, coalesce(max(CASE WHEN op = 'delete' THEN lsn END) OVER (PARTITION BY collection, id ORDER BY lsn), -1) AS gone FROM log),
m AS (SELECT collection, id, arg_max({'lsn': lsn, 'op': op, 'label': label, 'expires_at': expires_at}, lsn) AS s, max(gone) AS gone FROM g GROUP BY collection, id),
cur AS (SELECT m.collection, m.id, s.lsn AS lsn, s.label AS label, s.expires_at AS expires_at, (SELECT min(lsn) FROM g WHERE g.collection = m.collection AND g.id = m.id AND g.gone = m.gone AND g.op = 'upsert') AS since FROM m WHERE s.op = 'upsert')
"""


def version_log(spark, d):
    e = embeddings(spark, d)
    return e.select(
        F.col("vec_id").alias("lsn"), F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("collection"), (F.col("vec_id") % 40).alias("id"),
        F.when(F.col("vec_id") % 11 == 0, "delete").otherwise("upsert").alias("op"), "label", F.when(F.col("vec_id") % 7 == 0, F.col("vec_id").cast("double")).alias("expires_at"),
    )


@query(LOG + "SELECT * FROM cur")
def vector_upsert_state(spark, d):
    return collections.current(version_log(spark, d))


@query(LOG + "SELECT (SELECT count(*) FROM log)::BIGINT AS before, (SELECT count(*) FROM cur WHERE expires_at IS NULL OR expires_at > 100)::BIGINT AS after, ((SELECT count(*) FROM log) - (SELECT count(*) FROM cur WHERE expires_at IS NULL OR expires_at > 100))::BIGINT AS reclaimed")
def vector_compact(spark, d):
    return collections.compact(version_log(spark, d), as_of=100.0)[1]


@query(LOG + "SELECT collection, count(*)::BIGINT AS vectors, count(expires_at)::BIGINT AS with_expiry FROM cur GROUP BY ROLLUP (collection)")
def vector_collection_stats(spark, d):
    return collections.collection_stats(collections.current(version_log(spark, d)))


@query(LOG + "SELECT c.name AS collection, 64 AS dimensions, 'cosine' AS metric, (SELECT count(*) FROM cur WHERE collection = c.name)::BIGINT AS vectors FROM (SELECT 'c' || i AS name FROM range(0, 4) t(i)) c")
def vector_list_collections(spark, d):
    catalog = collections.Catalog()
    for i in range(4):
        catalog.create(f"c{i}", 64)
    rows = collections.list_collections(catalog.frame(spark), collections.current(version_log(spark, d)))
    return rows.withColumn("dimensions", F.col("dimensions").cast("int"))


VERSIONS = """
, v AS (SELECT vec_id % 100 AS id, vec_id // 100 AS version, vec_id AS ts, embedding::DOUBLE[] AS vector FROM embeddings),
w AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY version) AS valid_to FROM v)
"""


def versions(spark, d):
    return temporal.versions_from(embeddings(spark, d))


@query(VERSIONS + ", h AS (SELECT version, coalesce(valid_to, ts) AS ts, valid_to IS NULL AS current, row_number() OVER (ORDER BY version DESC) AS b FROM w WHERE id = 7) SELECT version, ts, current FROM h WHERE b <= 4")
def vector_history(spark, d):
    return temporal.history(versions(spark, d), 7, 3)


@query(VERSIONS + "SELECT id, version, round(list_cosine_similarity(vector, q.v), 6) AS score FROM w, q WHERE ts <= 250 AND (valid_to IS NULL OR valid_to > 250) ORDER BY list_cosine_similarity(vector, q.v) DESC, id LIMIT 10")
def vector_asof(spark, d):
    return rounded(temporal.query_as_of(versions(spark, d), the_vector(spark, d), 250, 10))


@query(VERSIONS + """, o AS (SELECT id, max(version) AS version FROM w WHERE valid_to <= 250 GROUP BY id UNION ALL SELECT id, min(version) FROM w GROUP BY id HAVING count(*) = 1)
SELECT o.id, o.version, round(list_cosine_similarity(w.vector, q.v), 6) AS score FROM o JOIN w ON o.id = w.id AND o.version = w.version, q ORDER BY list_cosine_similarity(w.vector, q.v) DESC, o.id LIMIT 10""")
def vector_asof_compat(spark, d):
    return rounded(temporal.query_as_of_replaced(versions(spark, d), the_vector(spark, d), 250, 10))


@query(VERSIONS + """, s AS (SELECT id, version, 1 - list_cosine_similarity(lag(vector) OVER (PARTITION BY id ORDER BY version), vector) AS d FROM w WHERE valid_to IS NOT NULL)
SELECT id, round(sum(coalesce(round(d, 6), 0)), 6) AS drift, CASE WHEN count(*) < 2 THEN count(*) ELSE count(*) + 1 END::BIGINT AS versions FROM s GROUP BY id""")
def vector_drift(spark, d):
    return temporal.drift(versions(spark, d))


@query("""
, t AS (SELECT id, payload, list_cosine_similarity(vector, v) AS cos, row_number() OVER (ORDER BY list_cosine_similarity(vector, v) DESC, id) AS p FROM col, q),
k AS (SELECT *, regexp_extract_all(lower(payload), '[a-z0-9_]+') AS w, regexp_extract_all('the item 17 of the collection', '[a-z0-9_]+') AS y FROM t),
g AS (SELECT *, list_distinct(flatten(list_transform(w, lambda x: [x] || list_transform(range(1, greatest(len(x) - 1, 1)), lambda i: substr(x, i, 3))))) AS a,
             list_distinct(flatten(list_transform(y, lambda x: [x] || list_transform(range(1, greatest(len(x) - 1, 1)), lambda i: substr(x, i, 3))))) AS b FROM k),
z AS (SELECT id, payload, CASE WHEN p <= 50 THEN 0.7 * cos + 0.3 * len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE ELSE cos END AS s FROM g)
SELECT id, payload, round(s, 6) AS score FROM z ORDER BY s DESC, id LIMIT 10""")
def vector_token_hybrid(spark, d):
    return rounded(search.token_hybrid(collection(spark, d), the_vector(spark, d), TEXT, 10)).select("id", "payload", "score")


@query("""SELECT count(*) FILTER (WHERE live)::BIGINT AS active, count(*) FILTER (WHERE live AND bucket = 3)::BIGINT AS filtered, count(*) FILTER (WHERE live AND bucket = 3)::BIGINT AS scored,
  least(count(*) FILTER (WHERE live AND bucket = 3), 10)::BIGINT AS hits, count(*) FILTER (WHERE live AND bucket = 3) < 10 AS short FROM (SELECT *, expires_at IS NULL OR expires_at > 100 AS live FROM col)""")
def vector_diagnostics(spark, d):
    return search.diagnostics(collection(spark, d), {"bucket": 3}, 100.0, 10)


@query()
def vector_ivf(spark, d):
    index = ann.build_ivf(collection(spark, d))
    return rounded(ann.ann_rerank(index, the_vector(spark, d), 10)[0]).select("id", "score")


@query()
def vector_hnsw(spark, d):
    index = ann.build_graph(collection(spark, d))
    return rounded(ann.hnsw(index, the_vector(spark, d), 10, {"bucket": 3})[0]).select("id", "score")


@query()
def vector_pq(spark, d):
    return rounded(ann.pq_rerank(ann.build_pq(collection(spark, d)), the_vector(spark, d), 10)).select("id", "score")


@query()
def vector_ncd(spark, d):
    return rounded(search.ncd_hybrid(collection(spark, d), the_vector(spark, d), 10)).select("id", "score")


@query()
def vector_compress(spark, d):
    return search.exact(collection(spark, d), the_vector(spark, d), 10).select("id", udfs.compress_payload()("payload").alias("payload"))


@query()
def vector_recall(spark, d):
    """Recall of inverted lists for every tenth vector; the exact ranking is the truth."""
    c, q = collection(spark, d), tenth(spark, d)
    return search.recall(ann.ivf_batch(ann.build_ivf(c), q, 10), search.batch(c, q, 10), 10)


@query()
def vector_recall_graph(spark, d):
    """The same of layered graphs."""
    c, q = collection(spark, d), tenth(spark, d)
    return search.recall(ann.hnsw_batch(ann.build_graph(c), q, 10), search.batch(c, q, 10), 10)
