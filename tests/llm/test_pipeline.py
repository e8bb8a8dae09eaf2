import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "mix", "pack"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_over_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    from tidefold.llm.common import keep

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, DATA))
        assert docs.columns == columns
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(left) <= ids
        ids = set(left)
        if name == "quality":
            assert all(labels[i] == 1 for i in ids if i in labels) and ids
        if name != "mix":
            assert len(left) == len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(left)


def test_empty_and_null_documents(spark, documents):
    docs = documents([])
    from tidefold.llm import lines, mixing, packing, simhash

    for f in (lines.strip_lines, simhash.drop_near_duplicates, mixing.repeat_documents, packing.pack_documents):
        docs_or_rows = f(documents([(None, None, None), (1, None, None), (2, "", "x"), (1, "a b c", None)]))
        assert docs_or_rows.count() >= 1
        assert f(docs).count() == 0


def test_pipeline_against_plain_versions_of_its_stages(spark, documents, prose, tmp_path):
    import random
    import zlib
    from collections import Counter

    import numpy as np
    from test_lines import brute
    from test_mixing import plain_copies
    from test_packing import padding
    from test_quality import plain_score, plain_statistics
    from test_simhash import plain_stays

    from tidefold.llm import packing, quality

    rng, common = random.Random(3), [prose(9000 + i, 9) + "." for i in range(6)]
    rows = []
    for i in range(90):
        lines = [prose(i * 7 + k, 14) + "." for k in range(rng.randint(2, 6))]
        if rng.random() < 0.4:
            lines.insert(1, rng.choice(common))
        rows.append((i, "\n".join(lines), f"s{i % 4}" if i % 9 else None))
    rows += [(100 + i, rows[i][1].replace(" ", "$$$ ").upper(), "s1") for i in range(30)]  # junk
    rows += [(200 + i, rows[i][1].replace(".", " x.", 1), "s2") for i in range(8)] + [(300, rows[5][1], "s3")]
    for i in range(6):  # near duplicates whose only lines differ by two words
        w = prose(8000 + i, 200).split()
        rows += [(400 + 10 * i + k, " ".join(w[:50] + [f"a{k}"] + w[51:150] + [f"b{k}"] + w[151:]) + ".", "s0") for k in range(3)]
    labels = {i: int(i < 100) for i, _, _ in rows if i < 130 and i % 3}
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    known = [(t, labels[i]) for i, t, _ in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    trees = quality.grow(np.array([plain_statistics(t.encode()) for t, _ in known]), np.array([q for _, q in known], float))
    good = [(i, t, s) for i, t, s in rows if plain_score(trees, plain_statistics(t.encode())) >= 0.5]
    texts = brute([(i, t) for i, t, _ in good])
    stripped = [(i, texts[i], s) for i, t, s in good if texts[i] == t or texts[i].split()]
    stays = set(plain_stays([(i, t) for i, t, _ in stripped]))
    kept = [r for r in stripped if r[0] in stays]
    mixed = [r for r, n in zip(kept, plain_copies(kept)) for _ in range(n)]
    assert len(rows) > len(good) > len(stripped) - 1 and len(stripped) > len(kept) and mixed

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = [len(t.split()) for _, t, _ in mixed]
    assert Counter((r.doc_id, r.length) for r in got) == Counter(zip([i for i, _, _ in mixed], lengths))
    bounds, cost = packing.optimal_boundaries(list(Counter(lengths).items()), 16)
    assert sum(r.padding for r in got) == cost == padding(list(Counter(lengths).items()), bounds)
