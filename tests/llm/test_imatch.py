import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash

from tidefold.llm.imatch import BAND, SUBSETS, compare_edited


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h64(values, seed=42):
    """The hash of longs, one after another."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def plain_terms(text):
    return sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split("[\\x20\\x09-\\x0D]+", text.lower()) if w})


def plain_fingerprint(text, lexicon):
    """(level, hashes of the subsets of one density, of half the density); -1 for a subset without terms."""
    short = lambda v: h64(v) & 0x7FFFFFFF
    every = plain_terms(text)
    own = [signed(xxhash.xxh64_intdigest(struct.pack("<i", 1), h64([t]) & (2**64 - 1))) for t in every if t in lexicon]
    if not own:
        return -1, [short(every)], [short(every)]
    level = len(own).bit_length() - 1
    out = []
    for c in (level, level + 1):
        mask = (1 << c) - 1
        sets = [[v for v in own if v & mask == k] for k in range(SUBSETS)]
        out.append([short(x) if x else -1 for x in sets])
    return level, *out


def plain_likeness(f, g):
    if (f[0] < 0) != (g[0] < 0) or abs(f[0] - g[0]) > 1:
        return 0.0
    x, y = (f[1] + f[2], g[1] + g[2]) if f[0] == g[0] else (f[1], g[2]) if f[0] > g[0] else (f[2], g[1])
    pairs = [(a, b) for a, b in zip(x, y) if max(a, b) >= 0]
    return sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0


def written(f):
    return f"{f[0]}:" + ":".join("".join("-" if v < 0 else f"{v:08x}" for v in part) for part in f[1:])


@pytest.mark.parametrize("n", [30, 120])
def test_against_a_plain_version(documents, prose, n):
    rows = [(i, prose(i, 20 + i * 5)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, prose(3, 35)), (n + 3, "Only these words here"), (n + 4, prose(1, 2000))]
    df = Counter(t for _, text in rows for t in plain_terms(text or ""))
    lexicon = {t for t, c in df.items() if BAND[0] * len(rows) <= c <= max(1.0, BAND[1] * len(rows))}
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in compare_edited(documents(rows)).collect()}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        f, g, h = (plain_fingerprint(x, lexicon) for x in (t, t[: len(t) - k] + nxt[:k], nxt))
        r = got[d]
        assert (r.fingerprint, r.edited_fingerprint) == (written(f), written(g))
        assert (r.near_edited, r.near_next) == (plain_likeness(f, g), plain_likeness(f, h))


def expected(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())
    return out


def test_edited_texts_and_likeness(documents, prose):
    rows = [(i, prose(i, 150)) for i in range(60)] + [(100, prose(3, 150)), (200, "Short text"), (201, None), (202, ""), (203, "é\U0001f600" * 50), (-5, prose(7, 3000))]
    got = {r.doc_id: r for r in compare_edited(documents(rows)).collect()}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == expected(rows)
    assert got[100].fingerprint == got[3].fingerprint and got[201].fingerprint == got[202].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    mean = lambda x: sum(x) / 60
    assert mean([got[i].near_edited for i in range(60)]) > 4 * mean([got[i].near_next for i in range(60)])
    assert got[202].near_edited == 1.0  # nothing to replace


def test_likeness_of_equal_and_next(documents, prose):
    t = prose(1, 90)
    got = {r.doc_id: r for r in compare_edited(documents([(2, t), (1, t)])).collect()}
    assert got[2].near_next == 1.0 and got[1].near_next == 1.0


def test_edges(documents, prose):
    assert compare_edited(documents([])).collect() == []
    (r,) = compare_edited(documents([(1, "abcdef")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(1, "abcdef"), (1, "abcdef"), (None, "xyzxyz"), (None, "xyzxyz"), (2, prose(2, 40))]
    got = compare_edited(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t)) for d, t in rows)
    assert {r.edited_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"abcdxy").hexdigest()}
