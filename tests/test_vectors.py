import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.functions import udfs
from tidefold.operators import ann, collections, search, temporal, tiles


def clustered(spark, seed=42):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 32))
    v = np.concatenate([c + 0.05 * rng.normal(size=(100, 32)) for c in centres]).astype(np.float32)
    rows = [(i, x.tolist(), i % 8) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "id long, vector array<float>, bucket int").repartition(4, "id").cache()


def truth(v, q, k, keep=None):
    s = v.astype(float) @ q / (np.linalg.norm(v.astype(float), axis=1) * np.linalg.norm(q))
    ids = [i for i in np.lexsort([np.arange(len(v)), -s]) if keep is None or keep(i)]
    return ids[:k]


def test_exact_and_filters(spark):
    v, c = clustered(spark)
    q = v[7].astype(float)
    assert [r.id for r in search.exact(c, q, 10).collect()] == truth(v, q, 10)
    assert [r.id for r in search.exact(c, q, 10, filters={"bucket": 3}).collect()] == truth(v, q, 10, lambda i: i % 8 == 3)
    assert search.exact(c, np.zeros(32), 3).select("score").distinct().collect()[0][0] == 0
    with pytest.raises(ValueError):
        search.exact(c, q, 0)


def test_batch_lanes_agree(spark, monkeypatch):
    v, c = clustered(spark)
    queries = c.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    want = {q: truth(v, v[q].astype(float), 5) for q in range(0, 500, 50)}
    for block in (4096, 3):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(tiles, "BROADCAST_BYTES", block * 256)
        monkeypatch.setattr(tiles, "TILE", block)
        for lane in (search.batch, search.batch_sql):
            rows = sorted(lane(c, queries, 5).collect(), key=lambda r: (r.qid, r.rank))
            assert {q: [r.id for r in rows if r.qid == q] for q in want} == want


def test_many_pairs_are_ranked_on_tiles_and_scored_alike(spark, monkeypatch):
    v, c = clustered(spark)
    c = c.select("id", "vector").unionAll(c.where("id < 3").select("id", F.reverse("vector").alias("vector")))
    queries = c.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    want, used = sorted(map(tuple, search.batch_sql(c, queries.where("qid > 0"), 5).collect())), []
    monkeypatch.setattr(search, "EXPRESSION_PAIRS", 100)
    monkeypatch.setattr(search, "batch", lambda *a: used.append(1) or tiles.batch(*a))
    assert sorted(map(tuple, search.batch_sql(c, queries.where("qid > 0"), 5).collect())) == want and used and len(want) == 45


def test_approximate_recall(spark):
    v, c = clustered(spark)
    ivf, pq = ann.build_ivf(c), ann.build_pq(c, 4, 64)
    graph = ann.build_graph(c)
    rng = np.random.default_rng(99)
    hits = {"ivf": 0, "hnsw": 0, "pq": 0}
    for i in rng.choice(500, 8, replace=False):
        q = v[i].astype(float) + 0.05 * rng.normal(size=32)
        want = set(truth(v, q, 10))
        for name, rows in (("ivf", ann.ann_rerank(ivf, q, 10)[0]), ("hnsw", ann.hnsw(graph, q, 10)[0]), ("pq", ann.pq_rerank(pq, q, 10))):
            hits[name] += len(want & {r.id for r in rows.collect()})
    assert all(h >= 0.9 * 80 for h in hits.values()), hits
    rows, info = ann.hnsw(graph, v[0].astype(float), 10, {"bucket": 5})
    assert all(r.bucket == 5 for r in rows.collect()) and rows.count() == 10 and info["attempts"] <= 2
    rows, info = ann.ann_rerank(ivf, v[0].astype(float), 10, {"bucket": 99})
    assert info["fallback"] and rows.count() == 0
    assert ivf.rows.count() == 500 and ivf.summary["lists"] == 22


def test_over_fetch_and_list_count():
    assert ann.over_fetch(10, 24, 10000, 1250) == 160
    assert ann.over_fetch(10, 24, 100, 0) == 0 and ann.over_fetch(10, 24, 15, 15) == 15
    assert [ann.list_count(n) for n in (1, 3, 100, 10**6)] == [1, 3, 10, 1000]
    assert search.merge_top([[(0.9, 1), (0.1, 2)], [(0.9, 0)]], 2) == [(0.9, 0), (0.9, 1)]


def test_catalog(spark):
    c = collections.Catalog()
    c.create("a", 2)
    assert c.create("a", 2, modality="text")[0] == 2
    for bad in (("a", 3), ("a", 2, "dot"), ("b", 0), ("b", 2, "hamming"), ("b", 2, "dot", "smell"), ("", 2)):
        with pytest.raises(ValueError):
            c.create(*bad)
    with pytest.raises(Exception, match="dimensions"):
        c.check("a", spark.createDataFrame([([1.0],)], "vector array<float>")).collect()


def test_null_filter_matches_missing(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, tag string")
    assert [r.id for r in search.candidates(rows, {"tag": None}).collect()] == [1]


def test_versions(spark):
    rows = [(1, n, n * 10, [1.0, float(n)]) for n in range(4)] + [(2, 0, 5, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, version long, ts long, vector array<float>")
    assert [(r.version, r.ts, r.current) for r in sorted(temporal.history(v, 1, 2).collect())] == [(1, 20, False), (2, 30, False), (3, 30, True)]
    assert {r.id: r.version for r in temporal.query_as_of(v, [1.0, 0.0], 15, 5).collect()} == {1: 1, 2: 0}
    assert {r.id: r.version for r in temporal.query_as_of_replaced(v, [1.0, 0.0], 20, 5).collect()} == {1: 1, 2: 0}
    assert {r.id: r.versions for r in temporal.drift(v).collect()} == {1: 4}
    with_current = {r.id: (r.versions, r.drift) for r in temporal.drift(v, include_current=True).collect()}
    assert with_current[2] == (1, 0.0) and with_current[1][0] == 4


def test_bytes_and_codecs(spark):
    raw = bytes(range(256)) * 3 + b"xy"
    assert udfs.unshuffle_bytes(udfs.shuffle_bytes(raw)) == raw and udfs.shuffle_bytes(b"abc") == b"abc"
    for name, work in udfs.CODECS.items():
        assert udfs.decompress(name, work(raw)) == raw
    df = spark.createDataFrame([("aaaa" * 50,), (None,)], "p string").select(udfs.compress_payload()("p").alias("z"))
    one, none = df.collect()
    assert one.z.original_size == 200 and one.z.ratio > 1 and (none.z is None or none.z.data is None)
    d = spark.createDataFrame([(bytearray(b"a" * 99), bytearray(b"a" * 99)), (bytearray(b""), bytearray(b""))], "a binary, b binary").select(udfs.ncd("a", "b")).collect()
    assert d[0][0] < 0.3 and udfs.CODECS["none"](b"x") == b"x"


def test_recall_is_of_every_tenth_vector(spark, tmp_path, monkeypatch):
    from tidefold.plans import vector_queries

    v = np.random.default_rng(5).normal(size=(2300, 8))
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(search, "recall", lambda found, truth, k: (found, truth))
    for ranking in vector_queries.vector_recall(spark, str(tmp_path)):
        assert sorted(r.qid for r in ranking.select("qid").distinct().collect()) == list(range(0, 2300, 10))


def overlap(found, want):
    return len({r.id for r in found.collect()} & set(want))


@pytest.mark.parametrize("shard", [20000, 700])
def test_recall_on_unclustered_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    c = spark.createDataFrame([(i, x.tolist(), i % 8) for i, x in enumerate(v)], "id long, vector array<float>, bucket int").repartition(4, "id").cache()
    q = c.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    want = search.batch(c, q, 10)
    ivf, graph, pq = ann.build_ivf(c), ann.build_graph(c), ann.build_pq(c)
    assert search.recall(ann.ivf_batch(ivf, q, 10), want, 10).first().recall_at_k >= 0.9
    assert search.recall(ann.hnsw_batch(graph, q, 10), want, 10).first().recall_at_k >= 0.9
    own = range(7, 3000, 600)
    for found in (lambda x: ann.ann_rerank(ivf, x, 10)[0], lambda x: ann.hnsw(graph, x, 10)[0], lambda x: ann.pq_rerank(pq, x, 10)):
        assert sum(overlap(found(v[i].astype(float)), truth(v, v[i].astype(float), 10)) for i in own) >= 0.85 * 10 * len(own)


def test_index_tables_are_stored_by_list(spark):
    _, c = clustered(spark)
    index = ann.build_ivf(c)
    plan = index.rows.where("list_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan
    assert index.rows.count() == 500 and 1 <= index.probes <= len(index.centroids)


def test_empty_and_null_collections(spark):
    schema = "id long, vector array<float>, bucket int"
    for rows in ([], [(1, None, 0)]):
        c = spark.createDataFrame(rows, schema)
        assert ann.build_graph(c).n == 0 and ann.hnsw(ann.build_graph(c), [1.0, 0.0], 3)[0].collect() == []
        q = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, qv array<double>")
        assert search.batch(c, q, 3).collect() == []
    one = spark.createDataFrame([(5, [1.0, 2.0], 0), (6, None, 0)], schema)
    assert [r.id for r in ann.ann_rerank(ann.build_ivf(one), [1.0, 0.0], 3)[0].collect()] == [5]
    assert [r.id for r in ann.hnsw(ann.build_graph(one), [1.0, 0.0], 3)[0].collect()] == [5]


def test_graph_links_are_mutual_and_bounded():
    rng = np.random.default_rng(3)
    v = ann.unit(rng.normal(size=(400, 16)))
    links = ann.layer_links(v, 8, 16, 32, "cosine")
    assert links.shape == (400, 16) and (links < 400).all() and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in links)
    assert not (links == np.arange(400)[:, None]).any() and (links >= 0).sum(1).min() >= 1
    g = ann.Graph.build(np.arange(400), v, 8, 32, "cosine")
    hits = sum(len({i for _, i in g.search(x.astype(np.float32), 40)[:10]} & set(truth(v, x, 10))) for x in v[::20])
    assert hits >= 0.95 * 200
