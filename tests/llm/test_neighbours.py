import math
import random

import pytest

from tidefold.llm import neighbours
from tidefold.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, query, k):
    ok = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for q, a in ok:
        if query(q):
            found = sorted((math.dist(a, b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, query, k):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).select("vec_id", "embedding")
    return sorted(tuple(r) for r in nearest(df, df.where(query), k).collect())


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-12, abs=0)


@pytest.mark.parametrize("tile", [16, 2048])
def test_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours, "PANEL", tile)
    rng = random.Random(tile)
    f = lambda: [float(x) for x in __import__("numpy").array([rng.gauss(0, 1) for _ in range(12)], "float32")]
    rows = [(i, f()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(2000 + i, [x * 1e-3 for x in f()]) for i in range(20)] + [(2100, [x * 1e6 for x in f()])]
    rows = [(i, [float(x) for x in __import__("numpy").array(v, "float32")]) for i, v in rows]
    same(run(spark, rows, "vec_id % 10 = 0", 10), brute(rows, lambda i: i % 10 == 0, 10))


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, []), (8, [float("inf"), 0.0]), (10, [1.0, 0.0]), (20, [0.0, 0.0])]
    same(run(spark, rows, "vec_id % 10 = 0", 10), brute(rows, lambda i: i % 10 == 0, 10))
    assert run(spark, [], "vec_id % 10 = 0", 10) == []
    assert run(spark, [(0, [1.0])], "vec_id % 10 = 0", 10) == []
