import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidefold.llm.mixing import OP3_SQL, mix_sources, repeat_documents
from tidefold.operators import scans


def targets(sizes, cap=3.0):
    """Sharing the excess again and again, as stated."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def plain_copies(rows):
    """How often each of the rows (doc_id, text, source) is taken: documents in order of their keys as long as they fit,
    and then the one that brings the source nearest to its target."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    def key(d, t):
        weight = max(0.05, 1.0 - 4.0 * (len(re.findall(r"[!#$%&*+/<=>@\\^_`{|}~]", t or "")) / max(1, len(t or ""))))
        drawn = f"{'' if d is None else d}:17:{hashlib.md5((t or '').encode()).hexdigest()}"
        return -math.log((int(hashlib.md5(drawn.encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / weight

    by, out = defaultdict(list), {}
    for i, (d, t, s) in enumerate(rows):
        by[s].append((key(d, t), size(t), i))
    goal = targets({s: sum(n for _, n, _ in x) for s, x in by.items()})
    for s, x in by.items():
        whole = sum(n for _, n, _ in x)
        epochs = int(goal[s] // whole) if whole else 0
        rest, used, taken = goal[s] - epochs * whole, 0, set()
        for _, n, i in sorted(x):
            if rest <= 0 or used + n > rest:
                break
            used += n
            taken.add(i)
        left = rest - used
        others = [(abs(left - n), k, i) for k, n, i in x if i not in taken and n and abs(left - n) < left]
        taken |= {min(others)[2]} if others else set()
        out |= {i: epochs + (i in taken) for _, _, i in x}
    return [out[i] for i in range(len(rows))]


def test_against_a_plain_version(documents, prose):
    rows = [r for r in rows_of(prose) if r[1]] + [(2000 + i, prose(i, 40) + " #$%" * 30, "a") for i in range(20)]
    want = Counter((d, t, n) for (d, t, _), n in zip(rows, plain_copies(rows)))
    got = Counter((r.doc_id, r.size, r.copies) for r in mix_sources(documents(rows)).collect())
    assert got == Counter((d, len(t.split()), n) for (d, t, n), c in want.items() for _ in range(c))


def rows_of(prose):
    return [(i, prose(i, 5 + i * 7 % 120), ("a", "b", "c", None, "zé", "\U0001f600")[min(5, i % 9)]) for i in range(300)] + [(900, None, "a"), (901, "", "only empty"), (None, "x y z", "b"), (902, "one two", "tiny")]


def test_targets_and_taken(documents, prose):
    rows = rows_of(prose)
    got = mix_sources(documents(rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    longest = max(size(t) for _, t, _ in rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(documents(rows)).collect()))


@pytest.mark.parametrize("hot", [5_000_000, 2])
def test_oracle(documents, prose, monkeypatch, hot):
    monkeypatch.setattr(scans, "HOT_ROWS", hot)
    df = documents(rows_of(prose))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toArrow())
    want = con.sql(OP3_SQL).fetchall()
    got = mix_sources(df).selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken", "source").collect()
    plain = lambda rows: sorted((str(a), b, c, round(t, 6), k, str(s)) for a, b, c, t, k, s in rows)
    assert plain(want) == plain([tuple(r) for r in got])


def test_null_ids_are_told_apart(documents, prose):
    rows = [(None, prose(i, 20), "a") for i in range(200)] + [(i, prose(i + 500, 30), "b") for i in range(200)]
    got = mix_sources(documents(rows), weights=(1, 5)).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 15
    assert 0 < sum(r.copies for r in got if r.source == "a") < 200


def test_one_more_document_brings_a_source_nearer(documents, prose):
    rows = [(i, prose(i, 900), "a") for i in range(20)] + [(100 + i, prose(100 + i, 10 + 22 * i), "a") for i in range(40)] + [(300, prose(1, 11_000), "b"), (301, prose(2, 11_500), "b")]
    got = mix_sources(documents(rows), weights=(1, 1)).collect()
    own = [r for r in got if r.source == "a"]
    assert own[0].target % own[0].source_size > 0 and abs(sum(r.copies * r.size for r in own) - own[0].target) <= 60


def test_repeats_rows(documents, prose):
    df = documents(rows_of(prose))
    want = Counter()
    for r in mix_sources(df).collect():
        want[r.doc_id] += r.copies
    out = repeat_documents(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_edges(documents):
    assert mix_sources(documents([])).collect() == []
    assert repeat_documents(documents([])).collect() == []
    assert [r.copies for r in mix_sources(documents([(1, None, None)])).collect()] == [0]
    got = mix_sources(documents([(1, "a b", "s"), (1, "a b", "s")])).collect()
    assert len({r.copies for r in got}) == 1
