import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidefold.llm.pii import LABELS, SECRET, Field, base_spans, find_personal, observed, secret_spans, train, trigger_tokens, variants

KINDS = ("email", "ip", "card", "phone")


def plain_luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        n = int(c) * (1 + i % 2)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and plain_luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


CASES = [
    "", "no data", "a@b.c", "a@b", "@b.c", "x a.b%c+d-e@f-g.h.i, y", "a@b.c@d.e", "a@b.c.d_e@f.g", "a@@b.c", "a@b..c", "a@b_c@d.e f@g.h",
    "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "001.002.003.004", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "41111111 11111111 1",
    "+1 (743) 555-3824", "+1", "+12", "++44 20 7946 0958", "+1 234", "+123456789012345678", "é+49 30 901820 é 10.0.0.1", "\U0001f600 a@b.cd", "+1.2.3.4.5.6.7.8.9.0 1", "1 " * 30,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert base_spans(text) == plain(text)


def test_base_spans_of_random_texts():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("a1 .@+-_()%é\n25") for _ in range(rng.randint(0, 60)))
        assert base_spans(text) == plain(text), text


def test_trigger_tokens():
    text = "(a1) x@y, none 555-3824. \t9\n<b@c>"
    assert [text[a:b] for a, b in trigger_tokens(text)] == ["a1", "x@y", "555-3824", "9", "b@c"]


def test_query(documents, prose):
    card, phone = "4111 1111 1111 1111", "+1 (743) 555-3824"
    rows = [(i, f"{prose(i, 20)} {card} {prose(i + 1, 5)} {phone} mail{i}@x.org 10.0.0.{i} {prose(i, 9)}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, prose(3, 30)), (None, "a@b.cd"), (5, rows[5][1]), (103, "x" * 200_000 + " a@b.cd")]
    got = find_personal(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts[d] = t or ""
    for r in got:
        base = plain(texts[r.doc_id])
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(line.split(",")) <= set(r.spans.split(",")) and (base or r.spans == "")
    assert find_personal(documents([])).collect() == []


def field(shapes, near=None):
    return Field({k: np.array(v, float) for k, v in shapes.items()}, np.ones((LABELS, LABELS)) if near is None else near)


def test_skip_chain_labels_a_repeated_token():
    f = field({"Xc": [6, 0, 0, 5, 0, 0], "Lc": [6, 0, 0, 5, 0, 0], "a1": [500, 0, 0, 0, 0, 0]}, np.diag([100.0, 1, 1, 1, 1, 1]))
    text = "pay 4111-1111-1111-1111 now " + "word " * 40 + "again 4222222222222223 and 4000000000000001 b7 " + "word " * 40 + "4111111111111111"
    spans = base_spans(text)
    labels = f.marginals(text, trigger_tokens(text), [3, 0, 0, 0, 0])
    assert labels[0, 3] > 0.99 and labels[4, 3] > 0.9 > 0.5 > labels[1, 3] and labels[3, 0] > 0.9
    more, hidden = f.added(text, spans)
    assert all(k in range(4) and a < b for a, k, b in more) and hidden == []
    assert f.added("no spans 12345", []) == ([], [])


def test_field_labels_documents_without_base_spans():
    text = "call 555-3824 or 12 times"
    f = field({"3-4": [0, 0, 0, 0, 500, 0], "2": [500, 0, 0, 0, 0, 0]})
    assert base_spans(text) == []
    assert f.added(text, [])[0] == [(5, 3, 13)]
    mail = text + " or a@b.cd"
    assert (5, 3, 13) in f.added(mail, base_spans(mail))[0]
    assert f.added("no number", []) == ([], []) and f.added("", []) == ([], [])


def exact_marginals(f, text, tokens, label):
    """By adding up all assignments of labels to tokens and hubs."""
    phi, ends = f.graph(text, tokens, label)
    total = np.zeros((len(tokens), LABELS))
    for x in itertools.product(range(LABELS), repeat=len(phi)):
        w = np.exp(sum(phi[i, k] for i, k in enumerate(x)) + sum(f.chains[k][x[i], x[j]] for i, j, k in ends))
        for i in range(len(tokens)):
            total[i, x[i]] += w
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("text,trees", [("x1 and y2 z33", True), ("555-3824 or 555-3824", False), ("a1 b2 a1", False), ("c 12 word 12", False)])
def test_marginals_against_all_assignments(text, trees):
    rng = np.random.default_rng(len(text))
    f = field({s: rng.integers(1, 9, LABELS) for s in ("a1", "a2", "3-4", "2")}, rng.integers(1, 9, (LABELS, LABELS)).astype(float))
    tokens = trigger_tokens(text)
    got, want = f.marginals(text, tokens, [0] * len(tokens)), exact_marginals(f, text, tokens, [0] * len(tokens))
    assert np.abs(got - want).max() < (1e-3 if trees else 0.06)
    fixed = [2] + [0] * (len(tokens) - 1)
    assert np.abs(f.marginals(text, tokens, fixed) - exact_marginals(f, text, tokens, fixed)).max() < (1e-3 if trees else 0.06)


def test_all_like_tokens_are_linked():
    text = " and ".join(["4111111111111111"] * 50 + ["x1"] * 50 + ["4111-1111-1111-1111"])
    f = field({"x": [1, 0, 0, 0, 0, 0]})
    phi, ends = f.graph(text, trigger_tokens(text), [0] * 101)
    skips = ends[ends[:, 2] == 2]
    assert len(phi) == 101 + 2 and sorted(np.bincount(skips[:, 1])[101:].tolist()) == [50, 51]


def test_secrets():
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'x token = "{secret}" then PASSWORD: abcdefghijklmnop1 and key=short1 or {secret} again'
    found = [text[a:b] for a, b in secret_spans(text)]
    assert found == [secret, "abcdefghijklmnop1"]
    f = field({"M6": [3, 0, 0, 0, 0, 3]})
    more, hidden = f.added(text, [], secret_spans(text))
    assert more == [] and [text[a:b] for a, b in hidden] == [secret]


def test_observed_meets_every_span():
    spans = [(0, 0, 40), (2, 1, 4), (6, 1, 8), (10, 2, 12), (14, 3, 16), (50, 1, 60)]
    assert observed([(0, 1), (6, 7), (38, 39), (41, 42), (55, 58), (70, 71)], spans, [(41, 45), (55, 58)]) == [1, 1, 1, SECRET, 2, 0]


def planted(prose, n):
    rng = random.Random(7)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    mail = lambda: f"user{rng.randint(1, 999)}@mail{rng.randint(1, 9)}.example.com"
    return [(i, f"{prose(i, 15)} {(phone, mail)[i % 2]()} {prose(i + 1, 9)} in {rng.randint(1900, 2030)} version {rng.randint(1, 9)}.{rng.randint(0, 9)}") for i in range(n)]


def test_finds_what_the_patterns_miss(documents, prose):
    """Fitted on one half; variants are planted in the other, and plain numbers are left alone."""
    rows = planted(prose, 240)
    f = train(documents(rows[:120]))
    hit = n = 0
    for i, t in rows[120:]:
        for s, k, e in base_spans(t):
            for v in variants(k, t[s:e]):
                changed = t[:s] + v + t[e:]
                more, _ = f.added(changed, base_spans(changed))
                hit += any(a < s + len(v) and b > s and x == k for a, x, b in more)
                n += 1
        more, _ = f.added(t, base_spans(t))
        assert more == []
    assert n > 120 and hit / n >= 0.9


def test_text_of_many_tokens():
    text = " ".join(f"{i % 977}" for i in range(60_000)) + " a@b.cd"
    f = field({"3": [500, 0, 0, 0, 0, 0], "2": [500, 0, 0, 0, 0, 0], "1": [500, 0, 0, 0, 0, 0]})
    assert f.added(text, base_spans(text)) == ([], [])
