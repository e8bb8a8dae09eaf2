import random

import pytest

from tidefold.llm import lines
from tidefold.llm.lines import LEAST_CHARS, LEAST_WORDS, NEAR_WORDS, dedup_lines, strip_lines


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1] <= 1


def brute(rows):
    """By document the lines that stay: one goes if any earlier line is equal or within the bound."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], {}
    for d, t in docs:
        stay = []
        for line in (t or "").split("\n"):
            w = line.lower().split()
            counts = len(w) >= LEAST_WORDS or sum(map(len, w)) >= LEAST_CHARS
            gone = counts and any(w == s or (len(w) >= NEAR_WORDS and len(s) >= NEAR_WORDS and distance_within_one(w, s)) for s in seen)
            if not gone:
                stay.append(line)
            if counts:
                seen.append(w)
        out[d] = "\n".join(stay)
    return out


@pytest.mark.parametrize("seed,few", [(1, 200000), (2, 200000), (3, 1)])
def test_matches_brute_force(documents, prose, seed, few, monkeypatch):
    for name in ("BROADCAST_KEYS", "BROADCAST_LINES", "BROADCAST_DOCS"):
        monkeypatch.setattr(lines, name, few)
    monkeypatch.setattr(lines, "HOT_PLACES", 3 if few == 1 else 50000)
    rng = random.Random(seed)
    common = [prose(seed * 100 + i, rng.choice([1, 2, 4, 8, 9, 12, 20])) for i in range(25)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(common).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                j = rng.randrange(len(w)) if w else 0
                kind = rng.randrange(3)
                w = w[:j] + (["new" + str(rng.randrange(50))] if kind != 1 else []) + w[j + (kind != 2) :]
            own.append((" " if rng.random() < 0.5 else "  ").join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(own)))
    got = {r.row.doc_id: r for r in dedup_lines(documents(rows)).collect()}
    assert {d: r.kept for d, r in got.items()} == brute(rows)
    assert all(r.n_lines - r.n_exact - r.n_near == r.n_kept for r in got.values())


def test_one_common_line_with_many_variants(documents, prose):
    base = prose(1, 30).split()
    rows = [(i, " ".join(base[:10] + [f"v{i}"] + base[10:])) for i in range(200)]
    got = {r.row.doc_id: r.kept for r in dedup_lines(documents(rows)).collect()}
    assert got[0] == rows[0][1] and all(not got[i] for i in range(1, 200))


def test_lines_of_one_long_word(documents):
    line, url = "这是一个没有空格的句子它在许多文档中重复", "https://example.org/a/long/path"
    rows = [(1, f"{line}\nshort\n{url}"), (2, f"short\n{line}\n{line[:19]}"), (3, f"{url}\n{line[:19]}")]
    got = {r.row.doc_id: r.kept for r in dedup_lines(documents(rows)).collect()}
    assert got == brute(rows) == {1: rows[0][1], 2: f"short\n{line[:19]}", 3: line[:19]}


def test_a_star_is_dealt_over_tasks(documents, prose, monkeypatch):
    monkeypatch.setattr(lines, "STAR_ROWS", 10)
    test_one_common_line_with_many_variants(documents, prose)


def test_long_lines(documents, prose):
    a = prose(4, 5000).split()
    b, c, d = a[:2500] + ["new"] + a[2501:], a[:4999], a[:100] + a[102:]
    got = {r.row.doc_id: r.n_near for r in dedup_lines(documents([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(d))])).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_runs_of_xor(spark):
    from pyspark.sql import functions as F

    rows = [([(i * 2654435761) ^ (i << 40) for i in range(n)],) for n in (1, 2, 3, 4, 5, 8, 9, 10, 17, 100)]
    got = spark.createDataFrame(rows, "v array<long>").select("v", lines.runs_of_xor(F.col("v"), F.size("v")).alias("x")).collect()
    for r in got:
        want = [0]
        for v in r.v:
            want.append(want[-1] ^ v)
        assert r.x == want


def test_edges_and_columns(documents, prose):
    t = prose(3, 12)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, t), (5, t + "\n" + prose(4, 9)), (None, t), (6, t), (6, t), (7, "one two"), (8, "one two")]
    df = documents(rows)
    got = strip_lines(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, None), (2, ""), (3, "\n\n"), (4, t), (5, prose(4, 9)), (7, "one two"), (8, "one two")], key=str)
    assert {r.doc_id: r.n_chars for r in got.collect()}[5] == len(prose(4, 9))
    assert strip_lines(documents([])).collect() == [] and dedup_lines(documents([])).collect() == []


def test_long_line(documents, prose):
    long = prose(8, 3000)
    rows = [(1, long), (2, long.replace(" ", "\t", 1)), (3, long + " more"), (4, long + " two more")]
    got = {r.row.doc_id: r.kept for r in dedup_lines(documents(rows)).collect()}
    assert got[1] == long and not got[2] and not got[3] and not got[4]
