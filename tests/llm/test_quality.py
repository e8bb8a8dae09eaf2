import os
import zlib

import numpy as np
import pytest

from tidefold.llm import quality
from tidefold.llm.quality import FEATURES, Trees, grow, keep_good, score_documents, statistics

DATA = "/root/testdata/sf0.01"


def plain_score(trees: Trees, x):
    total = trees.base
    for f, t, v in zip(trees.feature, trees.threshold, trees.value):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + (x[f[at]] > t[at])
        total += v[at - len(f)]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_walk_like_plain_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = grow(x[:300], y[:300])
    s = trees.scores(x)
    assert s == pytest.approx([plain_score(trees, r) for r in x])
    assert ((s[300:] >= 0.5) == y[300:]).mean() > 0.9


def plain_statistics(raw):
    """The same statistics, letter by letter and word by word."""
    n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    share = lambda keep: sum(keep(c) for c in raw) / n
    among = lambda chars: share(lambda c: c in chars)
    k = max(1, len(words))
    lower, upper = share(lambda c: 97 <= c <= 122), share(lambda c: 65 <= c <= 90)
    high = share(lambda c: c >= 128)
    p = [raw.count(bytes([c])) / n for c in set(raw)]
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lower + upper + high, upper / (lower + upper + 1e-9), among(b"0123456789"), among(b" \t\r"), among(b"\n"), among(b".?"),
        among(b"#$%&*+/<=>@\\^_`{}~"), among(b"|"), among(b"!"), high, -sum(x * np.log2(x) for x in p), mean, (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5,
        len(set(words)) / k, max((words.count(w) for w in words), default=0) / k, sum(x <= 3 for x in sizes) / len(sizes), sum(x > 12 for x in sizes) / len(sizes),
        len({(a, b) for a, b in zip(words, words[1:])}) / max(1, k - 1), sum(w[-1:] in (b"#", b"$", b"%", b"&", b"*", b"!", b"|") for w in words) / k,
        sum(w.isupper() for w in words) / k, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), sum(x.rstrip()[-1:] in (b".", b"?") for x in lines) / len(lines), among(b","),
    ]


def test_statistics_against_a_plain_version(prose):
    texts = ["", " ", "One. Two?\nONE! a|b $$$ 12,3", prose(1, 80), prose(2, 60).replace(" ", "!! ").upper(), "é" * 30 + "\n\n x#", "a b a b a b"]
    for t in texts:
        assert statistics(t.encode()) == pytest.approx(plain_statistics(t.encode()), abs=1e-12), t


def plain_grow(x, y):
    """Trees as lists of (feature, threshold) by node and values by leaf, every split tried one by one."""
    base, out = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    margin = np.full(len(y), base)
    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes, splits = [np.ones(len(y), bool)], []
        for _ in range(quality.DEPTH):
            below = []
            for rows in nodes:
                best = (1e-6, 0, np.inf)
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.RIDGE)  # noqa: B023, E731
                for j, c in enumerate(cuts):
                    for t in c:
                        left, right = rows & (x[:, j] <= t), rows & (x[:, j] > t)
                        if min(left.sum(), right.sum()) >= quality.LEAF_ROWS and (gain := part(left) + part(right) - part(rows)) > best[0] + 1e-12:
                            best = (gain, j, t)
                splits.append(best[1:])
                below += [rows & (x[:, best[1]] <= best[2]), rows & (x[:, best[1]] > best[2])]
            nodes = below
        for rows in nodes:
            margin[rows] += -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.RIDGE)
        out.append(splits)
    return out, 1 / (1 + np.exp(-margin))


def test_growing_against_a_plain_version(monkeypatch):
    for name, value in (("TREES", 4), ("DEPTH", 2), ("BINS", 8), ("LEAF_ROWS", 5)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5))
    y = ((x[:, 1] > 0.3) | (x[:, 4] + 0.3 * rng.normal(size=120) > 0.8)).astype(float)
    trees, (splits, scores) = grow(x, y), plain_grow(x, y)
    assert [[(int(f), float(t)) for f, t in zip(*tree)] for tree in zip(trees.feature, trees.threshold)] == [[(int(f), float(t)) for f, t in tree] for tree in splits]
    assert trees.scores(x) == pytest.approx(scores)


def test_statistics_are_finite():
    for raw in (b"", b" ", b"\n\n", b"a", b"\xff\xfe", "é".encode() * 1000, b"!" * 5000, b"x" * 300_000):
        s = statistics(raw)
        assert len(s) == len(FEATURES) and np.isfinite(s).all()


def test_edges(spark, documents, prose):
    rows = [(i, prose(i, 50)) for i in range(40)] + [(100 + i, prose(i, 50).replace(" ", "$$$ ")) for i in range(40)] + [(None, "x"), (1, prose(1, 50)), (900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 900] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    df = documents(rows)
    got = score_documents(df, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 900:
            assert r.predicted == int(r.doc_id < 100)
    kept = keep_good(df, labels)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 900) == sorted([*range(40), 1])
    assert score_documents(documents([]), labels).collect() == []
    assert len({r.score for r in score_documents(df, labels.limit(0)).collect()}) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
