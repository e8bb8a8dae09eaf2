import hashlib
import random

import numpy as np
import pytest

from tidefold.llm import repeats
from tidefold.llm.repeats import LEAF, equal_passages, multikey_quicksort, remove_repeats


def brute(rows, span):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, t in texts:
        for i in range(len(t) - span + 1):
            count[t[i : i + span]] = count.get(t[i : i + span], 0) + 1
    out = []
    for d, t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                hit[i : i + span] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((d, len(t), int(hit.sum()), spans, kept))
    return sorted(out, key=str)


def run(df, span):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, span).collect()), key=str)


def brute_words(rows, words):
    texts = [(d, (t or "").split()) for d, t in rows]
    owners = {}
    for d, t in texts:
        for i in range(len(t) - words + 1):
            owners.setdefault(tuple(t[i : i + words]), set()).add((d, tuple(t)))
    out = []
    for d, t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - words + 1):
            if len(owners[tuple(t[i : i + words])]) > 1:
                hit[i : i + words] = True
        out.append((d, int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())))
    return sorted(out, key=str)


def run_words(df, span, words):
    return sorted(((r.doc_id, r.n_shared_words, r.n_shared_spans) for r in remove_repeats(df, span, words).collect()), key=str)


@pytest.mark.parametrize("seed,hot,ranges", [(1, 2000, 1 << 20), (2, 2, 1 << 20), (3, 2000, 60), (4, 2, 60)])
def test_matches_brute_force(documents, prose, seed, hot, ranges, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    monkeypatch.setattr(repeats, "RANGE_ROWS", ranges)
    rng = random.Random(seed)
    passages = [prose(seed * 100 + i, 30) for i in range(6)]
    rows = []
    for i in range(40):
        parts = [prose(seed * 1000 + i * 10 + j, rng.randint(0, 25)) for j in range(3)]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts.insert(1, p[cut:] if rng.random() < 0.5 else p)
        if rng.random() < 0.2:
            parts += [parts[0], parts[0]]
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, rows[3][1][:-1] + "x")]
    assert run(documents(rows), 64) == brute(rows, 64)
    assert run_words(documents(rows), 64, 12) == brute_words(rows, 12)


def test_word_hashes():
    texts = [b"", b" a b\tc ", b"c", b"a\x0bb", "é é".encode(), b"\r\n", b"b a", b"cc"]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    h, stops = repeats.word_hashes(data, ends)
    words = [w for t in texts for w in t.split()]
    assert len(h) == len(words) and np.diff(np.concatenate([[0], stops])).tolist() == [len(t.split()) for t in texts]
    assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words)) == len(set(h.tolist()))


def test_covered():
    first, count = np.array([7, 0, 1, 30]), np.array([1, 1, 2, 3])
    assert repeats.covered(first, count, 5).tolist() == [[0, 12], [30, 37]]
    assert repeats.covered(first[:0], count[:0], 5).tolist() == []


def test_words_shared_across_documents_only(documents, prose, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_ROWS", 40)
    p, q = prose(1, 55), prose(2, 70)
    rows = [(1, f"{prose(3, 20)} {p}\n{prose(4, 9)}"), (2, f"{prose(5, 3)}\t{p}"), (3, f"{q} {prose(6, 5)} {q} {q}"), (4, " ".join(["word"] * 300)), (5, " ".join(["word"] * 200)), (6, " ".join(prose(7, 60).split()[:50])), (7, prose(7, 60)), (8, None), (9, " ".join(["own"] * 400))]
    got = run_words(documents(rows), 400, 51)
    assert got == brute_words(rows, 51)
    assert dict((d, n) for d, n, _ in got) == {1: 55, 2: 55, 3: 0, 4: 300, 5: 200, 6: 0, 7: 0, 8: 0, 9: 0}


def test_equal_hashes_of_unequal_passages(monkeypatch):
    monkeypatch.setattr(repeats, "window_hashes", lambda raw, starts, span: np.zeros(len(starts), np.uint64))
    raw = np.frombuffer(b"abcdefgh" + b"abcdefgi" + b"abcdefgh" + b"xxxxxxxx", np.uint8)
    assert equal_passages(raw, np.array([0, 8, 16, 24]), 8).tolist() == [True, False, True, False]
    assert equal_passages(raw, np.array([0, 8, 16, 24]), 8, np.array([1, 1, 1, 2]), np.zeros(4, bool)).tolist() == [False] * 4
    assert equal_passages(raw, np.array([0, 8, 16, 24]), 8, np.array([1, 1, 3, 2]), np.array([False, True, False, False])).tolist() == [True, True, True, False]


def test_edges(documents, prose):
    t = prose(5, 200)
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 900), (5, t), (5, t), (None, t), (None, None), (6, "é" * 300), (7, "x" + t), (8, "ab" * 300), (9, t[:63]), (10, t[:64])]
    assert run(documents(rows), 64) == brute(rows, 64)
    assert run(documents([]), 64) == []
    assert run(documents([(1, t)]), 64) == brute([(1, t)], 64)


def test_long_text(documents, prose):
    t = prose(9, 120_000)
    rows = [(1, t), (2, t[5000:5600]), (3, prose(10, 100))]
    got = {r.doc_id: r for r in remove_repeats(documents(rows)).collect()}
    assert got[2].n_removed == got[2].n_bytes and got[3].n_removed == 0
    assert got[1].n_removed == len(t[5000:5600].encode()) and got[1].n_spans == 1
    assert hashlib.sha256(bytes(got[1].kept)).digest() == hashlib.sha256((t[:5000] + t[5600:]).encode()).digest()


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    tokens = [rng.integers(0, 3, 5 * LEAF).astype(np.uint64) for _ in range(3)] + [rng.integers(0, 1 << 60, 5 * LEAF).astype(np.uint64)]
    order = multikey_quicksort(tokens)
    rows = list(zip(*(t.tolist() for t in tokens)))
    assert [rows[i] for i in order] == sorted(rows)


def test_keys_compare_like_tokens():
    rng = np.random.default_rng(5)
    tokens = [rng.integers(0, 1 << 62, 3000).astype(np.uint64) * np.uint64(4) for _ in range(2)] + [rng.integers(0, 300, 3000).astype(np.uint64)]
    tokens[0][:2000] = tokens[0][0]
    key = repeats.sort_key(tokens)
    assert (np.argsort(key, kind="stable") == multikey_quicksort(tokens)).all()


def test_equal_passages():
    raw = np.frombuffer(b"abcdefgh" * 3 + b"abcdefgi", np.uint8)
    starts = np.array([0, 8, 16, 24, 3])
    assert equal_passages(raw, starts, 8).tolist() == [True, True, True, False, False]
