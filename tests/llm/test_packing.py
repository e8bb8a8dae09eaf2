import itertools
import random
from collections import Counter, defaultdict

import pytest

from tidefold.llm import packing
from tidefold.llm.packing import optimal_boundaries, pack_documents


def padding(histogram, bounds):
    return sum(k * (min(b for b in bounds if b >= c) - c) for c, k in histogram)


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    h = [(x, rng.choice([1, 2, 50])) for x in rng.sample(range(40), rng.randint(1, 9))]
    for k in range(1, 6):
        bounds, cost = optimal_boundaries(h, k)
        top = max(h)[0]
        best = min(padding(h, [*c, top]) for n in range(min(k, len(h))) for c in itertools.combinations([x for x, _ in h if x < top], n))
        assert cost == best == padding(h, bounds) and len(bounds) <= k and bounds == sorted(bounds)


def test_batches(documents, prose, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    rows = [(i, prose(i, 1 + i * 13 % 200)) for i in range(300)] + [(500, None), (501, ""), (None, "a b"), (7, prose(7, 92)), (600, prose(1, 5000)), (601, "w " * 33_001), (602, "w " * 33_003), (603, "w " * 70_001)]
    got = pack_documents(documents(rows), 4, 1000).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    batches, lengths = defaultdict(list), {}
    for r in got:
        assert 0 <= r.padding == r.padded_length - r.length
        batches[r.bucket, r.shard, r.batch].append(r.length)
        lengths.setdefault(r.bucket, set()).add(r.padded_length)
    assert all(len(x) == 1 for x in lengths.values())
    for (bucket, _, _), b in batches.items():
        assert len(b) * min(lengths[bucket]) <= 1000 or len(b) == 1
    bounds, cost = optimal_boundaries(list(Counter(len((t or "").split()) for _, t in rows).items()), 4)
    assert sum(r.padding for r in got) == cost


def test_edges(documents):
    assert pack_documents(documents([])).collect() == []
    (r,) = pack_documents(documents([(1, None)])).collect()
    assert (r.length, r.padding) == (0, 0)
    assert optimal_boundaries([], 3) == ([], 0)
