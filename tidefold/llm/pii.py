"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what the patterns miss.

The patterns give the base spans. Tokens with a digit or an at sign are the nodes of a graph for each document:
consecutive ones share chain potentials, which depend on whether letters lie between them, and tokens with equal or
similar cores, however distant, share skip potentials that favour the same label. All tokens of a core hang on one hub,
a label of its own, so that links grow with the tokens and not with their pairs. Tokens inside base spans are observed,
and so are assigned secrets (`token = "..."`), a label of their own. Loopy message passing gives the others' marginals;
what is confidently personal becomes a span.

Potentials are trained piecewise on the observed tokens of a bounded sample, and on variants of the base spans that the
patterns miss (without country codes, with other separators, without a top-level domain) with plain numbers beside them;
the field then labels all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import table, tidy, whole

KINDS = ("email", "ip", "card", "phone")
#: Labels of a token: none, the kinds in order, secret.
LABELS, SECRET = 6, 5
#: Potentials are trained on about this many documents at most.
TRAIN_DOCS = 20000
#: Added spans have at least this marginal. Messages pass at most ROUNDS times.
CONFIDENT, ROUNDS, SKIP_WEIGHT, DAMPING = 0.9, 12, 4.0, 0.3
#: Edges whose messages are computed at once.
EDGES_AT_ONCE = 1 << 17

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does, as the leftmost one must, and takes whole runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")
EDGES = "()[]{}<>,.;:!?\"'|"
SPACE = re.compile(r"[\x20\x09-\x0D]")
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_=-]{16,})")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number))]
    return sum(doubled) % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of local part, at sign and domain, found from the at signs."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(number := digits(m[0])) <= 19 and luhn(number):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits(m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def trigger_tokens(text: str) -> list[tuple[int, int]]:
    """The words with a digit or at sign, without punctuation at their ends."""
    out, done = [], 0
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and not SPACE.match(text, a - 1):
            a -= 1
        s = SPACE.search(text, b)
        b = done = s.start() if s else len(text)
        while text[a] in EDGES:
            a += 1
        while text[b - 1] in EDGES:
            b -= 1
        out.append((a, b))
    return out


SIZES = ((1, "1"), (2, "2"), (3, "3"), (4, "4"), (9, "5"), (13, "d"), (19, "c"))
RUNS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def shape(token: str) -> str:
    """Runs of letters and of digits (with a class for their length), other characters as they are. Long runs that mix
    letters and digits are one thing, M with the logarithm of their length. Tokens of 14 to 19 digits begin with L or X,
    as they pass Luhn's check or not."""
    if MIXED.fullmatch(token) and any(c.isalpha() for c in token) and any(c.isdigit() for c in token):
        return f"M{len(token).bit_length()}"
    number = digits(token)
    parts = [("L" if luhn(number) else "X") if 14 <= len(number) <= 19 else ""]
    for m in RUNS.finditer(token):
        x = m[0]
        parts.append(next((c for n, c in SIZES if len(x) <= n), "n") if "0" <= x[0] <= "9" else "a" if x[0].isalpha() else x)
    return "".join(parts)


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Values of 16 characters or more, with a digit, that are assigned to something called a token, secret, password or key."""
    return [m.span(1) for m in ASSIGNED.finditer(text) if any(c.isdigit() for c in m[1])] if "=" in text or ":" in text else []


def observed(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """For each token the label of the first base span that meets it, else SECRET if a secret does, else 0. Spans of one
    kind don't overlap, so one place in each kind's spans is enough."""
    by = [[(s, e) for s, kind, e in spans if kind == k] for k in range(len(KINDS))] + [secrets]
    at, out = [0] * len(by), []
    for a, b in tokens:
        met = []
        for k, own in enumerate(by):
            while at[k] < len(own) and own[at[k]][1] <= a:
                at[k] += 1
            if at[k] < len(own) and own[at[k]][0] < b:
                met.append((k == SECRET - 1, own[at[k]][0], k + 1))
        out.append(min(met)[2] if met else 0)
    return out


def contexts(text: str, tokens: list[tuple[int, int]]) -> list[str]:
    """For each token the last run of letters, in lower case, between the token before and it; '#' if there are no letters."""
    out, done = [], 0
    for a, b in tokens:
        e = a
        while e > done and not text[e - 1].isalpha():
            e -= 1
        s = e
        while s > done and text[s - 1].isalpha():
            s -= 1
        out.append(text[s:e].lower() or "#")
        done = b
    return out


def cores(token: str) -> set[str]:
    """What like tokens have in common: the token, its digits if 7 or more, the last 7 of 10 or more."""
    token = token.lower()
    number = digits(token)
    return {token, number if len(number) >= 7 else token, "~" + number[-7:] if len(number) >= 10 else token}


class Field:
    """Log potentials: node by shape and by context, chain by labels of consecutive tokens, without letters between them
    ('near') or with ('far')."""

    def __init__(self, shapes: dict[str, np.ndarray], near: np.ndarray, far: np.ndarray | None = None, context: dict[str, np.ndarray] | None = None):
        total = sum(shapes.values(), np.zeros(LABELS)) + np.array([50.0, 1, 1, 1, 1, 1])
        prior = total / total.sum()
        self.node = {s: np.log((n + 2 * prior) / (n.sum() + 2)) for s, n in shapes.items()}
        self.unseen = np.log(prior * np.array([1, 0.05, 0.05, 0.05, 0.05, 0.05]) + 1e-9)
        self.context = {}
        for word, n in (context or {}).items():
            share = (n + 5 * prior) / (n.sum() + 5)
            self.context[word] = np.clip(np.log(share / prior), -2, 2)

        def joint(counts):
            p = counts + 1
            p = p / p.sum()
            return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -3, 3)

        self.chains = [joint(near), joint(np.zeros((LABELS, LABELS)) if far is None else far), np.eye(LABELS) * SKIP_WEIGHT]

    def graph(self, text: str, tokens: list[tuple[int, int]], label: list[int]):
        """Log potentials of the tokens and then of the hubs, and the edges' ends and kinds (near, far, skip)."""
        n, ctx, neutral = len(tokens), contexts(text, tokens), np.zeros(LABELS)
        phi = [self.node.get(shape(text[a:b]), self.unseen) + self.context.get(c, neutral) for (a, b), c in zip(tokens, ctx)]
        members: dict[str, list[int]] = defaultdict(list)
        for i, (a, b) in enumerate(tokens):
            for core in cores(text[a:b]):
                members[core].append(i)
        hubs = sorted({tuple(m) for m in members.values() if len(m) > 1})  # cores with the same tokens share a hub
        ends = [(i, i + 1, 0 if ctx[i + 1] == "#" else 1) for i in range(n - 1)]
        ends += [(i, n + h, 2) for h, m in enumerate(hubs) for i in m]
        phi = np.concatenate([np.array(phi).reshape(-1, LABELS), np.zeros((len(hubs), LABELS))])
        for i, k in enumerate(label):
            if k:
                phi[i] = -30
                phi[i, k] = 0
        return phi, np.array(ends, np.int32).reshape(-1, 3)

    def marginals(self, text: str, tokens: list[tuple[int, int]], label: list[int]) -> np.ndarray:
        """Of the tokens' labels, by loopy message passing in at most ROUNDS rounds."""
        phi, ends = self.graph(text, tokens, label)
        m = len(ends)
        src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        weights = [np.exp(x) for x in self.chains] + [np.exp(x.T) for x in self.chains]
        kind = np.concatenate([ends[:, 2], ends[:, 2] + 3])
        msg = np.zeros((2 * m, LABELS), np.float32)

        def beliefs():
            out = phi.copy()
            np.add.at(out, dst, msg)
            return out

        for _ in range(ROUNDS if m else 0):
            belief, new, step = beliefs(), np.empty_like(msg), 0.0
            for s in range(0, 2 * m, EDGES_AT_ONCE):
                e = np.arange(s, min(s + EDGES_AT_ONCE, 2 * m))
                x = belief[src[e]] - msg[(e + m) % (2 * m)]
                x = np.exp(x - x.max(1, keepdims=True))
                y = np.empty_like(x)
                for k, w in enumerate(weights):
                    own = kind[e] == k
                    if own.any():
                        y[own] = x[own] @ w
                y = np.log(y / y.sum(1, keepdims=True))
                step = max(step, float(np.abs(y - msg[e]).max()))
                new[e] = DAMPING * msg[e] + (1 - DAMPING) * y
            msg = new
            if step < 1e-4:
                break
        belief = beliefs()[: len(tokens)]
        return np.exp(belief - np.logaddexp.reduce(belief, 1, keepdims=True))

    def added(self, text: str, spans: list[tuple[int, int, int]], secrets: list[tuple[int, int]] = ()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Spans of tokens outside the base spans with a confident label, and secrets besides those given. Neighbours
        without letters between them that are cards or phones are one span. A document without a digit or at sign has none."""
        tokens = trigger_tokens(text)
        label = observed(tokens, spans, list(secrets))
        if all(label):
            return [], []
        p = self.marginals(text, tokens, label)
        more, hidden, ctx = [], [], contexts(text, tokens)
        last = None
        for i, (a, b) in enumerate(tokens):
            k = int(p[i].argmax())
            if label[i] or not k or p[i, k] < CONFIDENT:
                last = None
                continue
            if k == SECRET:
                hidden.append((a, b))
            elif k in (3, 4) and last == k and ctx[i] == "#":
                more[-1] = (more[-1][0], k - 1, b)
            else:
                more.append((a, k - 1, b))
            last = k
        return more, hidden


def variants(kind: int, span: str) -> list[str]:
    """A base span as the patterns miss it."""
    if kind == 0:
        return [span.rpartition("@")[0] + "@" + span.rpartition("@")[2].partition(".")[0]]
    if kind == 2:
        d = digits(span)
        return [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in "./"]
    if kind == 3:
        local = re.sub(r"^\+[0-9]{1,3}(?=[^0-9])[\x20.-]*", "", span)
        d = digits(local)
        return [local] + [f"{d[:-7]}{sep}{d[-7:-4]}{sep}{d[-4:]}" for sep in "-." if len(d) > 7]
    return []


def numbers(span: str) -> list[str]:
    """Plain numbers from a span's digits: counts, years, versions, dates."""
    d = digits(span)
    return [d[:1], d[:2], d[:3], d[:4], f"{d[0]}.{d[1]}", f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:2]}:{d[2:4]}"] if len(d) >= 8 else []


def training_counts(text: str, counts: dict) -> None:
    """Adds to counts of ('node', shape, label), ('near' or 'far', label before, label) and ('word', context, label)."""
    tokens, spans = trigger_tokens(text), base_spans(text)
    label, ctx = observed(tokens, spans, secret_spans(text)), contexts(text, tokens)
    for i, ((a, b), k) in enumerate(zip(tokens, label)):
        counts["node", shape(text[a:b]), k] += 1
        counts["word", ctx[i], k] += 1
        if i:
            counts["near" if ctx[i] == "#" else "far", str(label[i - 1]), k] += 1
    for s, kind, e in spans:
        for v in variants(kind, text[s:e]):
            inner = trigger_tokens(v)
            for i, (a, b) in enumerate(inner):
                counts["node", shape(v[a:b]), kind + 1] += 1
                if i:
                    counts["near", str(kind + 1), kind + 1] += 1
        for v in numbers(text[s:e]):
            counts["node", shape(v), 0] += 1


def train(docs: DataFrame) -> Field:
    """Counts over a hash sample of documents, labelled by base spans and assigned secrets."""
    every = max(1, -(-docs.count() // TRAIN_DOCS))
    part = docs.where(F.pmod(F.xxhash64(F.xxhash64("doc_id", F.length("text"))), F.lit(every)) == 0).select("text")

    def run(batches):
        counts: dict[tuple[str, str, int], int] = defaultdict(int)
        for batch in batches:
            for t in batch.column("text"):
                training_counts(t.as_py() or "", counts)
        if counts:
            (what, key, label), n = zip(*counts), list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(key), pa.array(label, pa.int32()), pa.array(n, pa.int64())], names=["what", "key", "label", "n"])

    rows = part.mapInArrow(tidy(run), "what string, key string, label int, n long").groupBy("what", "key", "label").agg(F.sum("n").alias("n"))
    tables: dict[str, dict[str, np.ndarray]] = {"node": {}, "word": {}}
    chain = {"near": np.zeros((LABELS, LABELS)), "far": np.zeros((LABELS, LABELS))}
    for what, key, label, n in rows.where("what IN ('near', 'far') OR n > 1").collect():
        if what in chain:
            chain[what][int(key), label] = n
        else:
            tables[what].setdefault(key, np.zeros(LABELS))[label] = n
    return Field(tables["node"], chain["near"], chain["far"], tables["word"])


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, secrets, n_found: one row per row of
    (doc_id, text).

    The counts and the hash are those of the base spans; spans has the added ones too, as kind:start:end in code
    points by start, then kind. secrets has assigned secrets and what the field finds like them, as start:end; n_found
    counts both. A null text is empty; a text without spans has counts of 0 and empty lists. Null ids and repeated rows
    are answered each. An empty table gives an empty result. The field takes some 600 bytes for each token of a text.
    """
    field = train(docs) if field is None else field

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base, secrets = base_spans(text), secret_spans(text)
                more, hidden = field.added(text, base, secrets)
                secrets = sorted(secrets + hidden)
                n = [0, 0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more), ",".join(f"{a}:{b}" for a, b in secrets), len(base) + len(more) + len(secrets)))
            if rows:
                names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "secrets", "n_found"]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, secrets string, n_found long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(tidy(run), out)


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))
