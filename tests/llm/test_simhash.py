import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidefold.llm import simhash
from tidefold.llm.links import components
from tidefold.llm.simhash import drop_near_duplicates, fingerprint, large_labels, near_duplicates, plan, shingle_set, similar_links


def plain_fingerprint(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, width, threshold):
    fp = [plain_fingerprint(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= threshold:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, fp[i] - (1 << 64) if fp[i] >> 63 else fp[i], low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def copies(prose, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = prose(seed * 50 + i % 20, 60).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("threshold,small", [(2, 48), (2, 3), (5, 48)])
def test_matches_brute_force(documents, prose, monkeypatch, threshold, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rows = copies(prose, 150, 3) + [(300, None), (301, ""), (302, "Word"), (303, "word"), (None, "two words"), (None, "\t\n"), (5, prose(1, 10)), (5, prose(1, 10))]
    got = sorted((tuple(r) for r in near_duplicates(documents(rows), 3, threshold).collect()), key=str)
    assert got == brute(rows, 3, threshold)
    assert near_duplicates(documents([]), 3, 2).collect() == []


def test_large_buckets_by_flips_and_blocks():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 300, np.uint64)
    fp = np.unique(np.concatenate([centre] + [centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (20, 2))]))
    none = np.zeros(len(fp), np.uint64)
    assert len(fp) > 4000
    flips = large_labels(fp, none, 2, 128)
    blocks = large_labels(fp[::-1].copy(), none, 2, 128)[::-1]
    groups = lambda x: sorted(map(tuple, {k: np.flatnonzero(x == k).tolist() for k in np.unique(x)}.values()))
    assert groups(flips) == groups(blocks)


def test_probe_of_buckets_over_batches():
    rng = np.random.default_rng(4)
    value = np.sort(np.concatenate([np.zeros(300, np.int64), rng.integers(1, 6, 40), np.full(90, 9)]))
    fp = np.where(value == 0, 5, rng.integers(0, 1 << 40, len(value))) ^ (np.int64(1) << rng.integers(0, 3, len(value)))
    part, ids, more = np.zeros(len(value), np.int32), np.arange(len(value)), np.zeros(len(value), np.int64)
    cols = [part, value, ids, fp, more]
    names = ["part", "value", "id", "fp", "more"]

    def groups(cuts):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[s:e]) for c in cols], names=names) for s, e in zip([0, *cuts], [*cuts, len(value)])]
        pairs = [(a, b) for out in simhash.probe(2, 128)(batches) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        return simhash.joined_sets(len(value), *(np.array(x, np.int64) for x in zip(*pairs))).tolist()

    want = [min(j for j in range(len(value)) if value[j] == value[i] and simhash.apart(fp[i : i + 1].view(np.uint64), fp[j : j + 1].view(np.uint64))[0] <= 2) if value[i] == 0 else None for i in range(len(value))]
    whole = groups([])
    assert [w for w in want if w is not None] == whole[:300] and whole == groups([10, 50, 299, 310]) == groups([300]) == groups(list(range(7, len(value), 7)))


@pytest.mark.parametrize("threshold", [1, 2, 3, 10])
def test_plan_is_complete(threshold):
    sample = np.random.default_rng(0).integers(0, 1 << 63, 500, np.uint64)
    parts = plan(sample, threshold, 1, 500)
    assert sorted(b for p, _ in parts for b in p) == list(range(64))
    assert sum(t for _, t in parts) == threshold - len(parts) + 1 and all(t >= -1 for _, t in parts)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 199)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_document_of_each_group_stays(documents, prose):
    base = [(i, prose(900 + i, 300)) for i in range(20)]
    near = [(100 + i, t.replace(t.split()[150], "changed", 1)) for i, t in base[:10]]
    rows = base + near + [(200, base[0][1]), (201, base[0][1]), (201, base[0][1]), (None, base[1][1]), (300, None), (301, "")]
    df = documents(rows)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [*range(20), 300]
    assert drop_near_duplicates(documents([])).collect() == []
    assert len(drop_near_duplicates(documents([(1, "a b"), (1, "a b")])).collect()) == 1


def test_fingerprint_of_long_text(prose):
    t = prose(4, 70_000)
    assert fingerprint(t.encode(), 3) == [plain_fingerprint(t, 3)]


def plain_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return (not a and not b) or 9 * len(a & b) >= 4 * (len(a) + len(b))


def plain_stays(rows):
    """The ids that stay: one of each group that pairs with a similarity of 0.8 or more connect."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    return sorted({root[i]: min(d for k, (d, _) in enumerate(rows) if root[k] == root[i]) for i in range(len(rows))}.values())


@pytest.mark.parametrize("block", [500000, 2000])
def test_only_pairs_of_the_stated_similarity_are_dropped(documents, prose, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rng, rows = random.Random(7), []
    for i in range(12):
        base = prose(3000 + i, 200).split()
        rows.append((i, " ".join(base)))
        for k, edits in enumerate((1, 3, 4, 5, 6, 7, 9)):  # similarities of about 0.95 to 0.6
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = f"y{rng.randrange(10**6)}"
            rows.append((100 + 10 * i + k, " ".join(w)))
    hot = prose(1, 120)
    rows += [(1000 + i, f"{hot} n{i}") for i in range(60)]
    # a repeated phrase fills the fingerprint, not the set of shingles
    rows += [(2000 + i, "buy it now for less " * 200 + prose(5000 + i, 60)) for i in range(3)]
    got = sorted(r.doc_id for r in drop_near_duplicates(documents(rows)).collect())
    assert got == plain_stays(rows) and {2000, 2001, 2002} <= set(got) and len(got) < len(rows)


def test_similar_links_match_all_pairs(prose):
    rng = random.Random(2)
    base = [prose(i, 80).split() for i in range(4)]
    texts = [" ".join(w if rng.random() > 0.015 else f"z{rng.randrange(99)}" for w in rng.choice(base)) for _ in range(60)]
    sets, ids = [shingle_set(t.encode(), 5) for t in texts], np.arange(60)
    block = np.array([rng.randrange(2) for _ in texts])
    for across in (False, True):
        want = [(i, j) for i in range(60) for j in range(i) if alike(set(sets[i].tolist()), set(sets[j].tolist())) and (not across or block[i] != block[j])]
        label = lambda pairs: simhash.joined_sets(60, *(np.array(x, np.int64) for x in zip(*pairs))).tolist()
        a, b = similar_links(ids, sets, block, across)
        assert label(list(zip(a, b))) == label(want)
        assert all(alike(set(sets[i].tolist()), set(sets[j].tolist())) for i, j in zip(a, b))


def test_bands_hold_pairs_at_the_limit():
    rng = np.random.default_rng(3)
    sets = rng.integers(0, 1 << 63, (20000, 10), np.uint64)  # of each, 9 and 9 with 8 in common; 0.01 missed are expected
    assert sum(not (simhash.band_keys(h[:9]) == simhash.band_keys(h[1:])).any() for h in sets) <= 1


def test_corpus_deduplication_compares_no_fingerprints(documents, prose, monkeypatch):
    """Fingerprints of texts in one language are alike by the square of the texts; bands aren't."""
    monkeypatch.setattr(simhash, "links", None)
    rows = [(i, prose(7000 + i, 80)) for i in range(200)]
    near = [(1000 + i, f"{t} more") for i, t in rows[::20]]
    assert sorted(r.doc_id for r in drop_near_duplicates(documents(rows + near)).collect()) == list(range(200))
    distinct = simhash.sketches(documents(rows + near)).withColumn("id", F.col("doc_id"))
    assert {(r.a, r.b) for r in simhash.candidates(distinct).collect()} == {(1000 + i, i) for i in range(0, 200, 20)}
