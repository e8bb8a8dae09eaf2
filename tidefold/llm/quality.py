"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once for all documents and kept in the shared folder. Trees are grown on the
driver from a bounded sample of labelled rows; all else covers all documents. The trees are flattened into arrays that
numpy walks for whole batches at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import cut, table, tidy

#: The trees are grown on at most this many labelled rows, those with the smallest hashes of their ids.
TRAIN_ROWS = 30000
TREES, DEPTH, BINS, RATE, LEAF_ROWS, RIDGE = 80, 4, 64, 0.15, 8, 2.0

FEATURES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "blank", "newlines", "stops", "symbols", "bars", "bangs", "high",
    "byte_entropy", "word_mean", "word_sd", "distinct_words", "top_word", "short_words", "long_words", "word_bigrams",
    "symbol_ends", "upper_words", "distinct_lines", "line_mean", "stop_lines", "commas",
)

_CLASS = np.zeros((256, 9), np.float64)
for _i, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r", b"\n", b".?", b"#$%&*+/<=>@\\^_`{}~", b"|", b"!")):
    _CLASS[list(_members), _i] = 1


def statistics(raw: bytes) -> list[float]:
    """FEATURES of one text; all finite, also for an empty one."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(raw))
    lower, upper, digits, blank, newlines, stops, symbols, bars, bangs = (counts @ _CLASS / n).tolist()
    high = float(counts[128:].sum()) / n
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    words = raw.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) / max(1, k - 1)
    ends = sum(w[-1:] in b"#$%&*!|" for w in words) / k
    shout = sum(w.isupper() for w in words) / k
    lines = raw.split(b"\n")
    full = sum(x.rstrip()[-1:] in (b".", b"?") for x in lines) / len(lines)
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), lower + upper + high, upper / (lower + upper + 1e-9), digits, blank, newlines, stops, symbols, bars, bangs, high,
        entropy, float(sizes.mean()), float(sizes.std()), len(seen) / k, max(seen.values(), default=0) / k, float((sizes <= 3).mean()), float((sizes > 12).mean()), pairs,
        ends, shout, len(set(lines)) / len(lines), float(np.log1p(len(raw) / len(lines))), full, float(counts[44]) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """`docs` (any columns with doc_id, text) reduced to doc_id and x, the FEATURES of the whole text."""

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, x array<double>")


class Trees:
    """Complete binary trees of one depth in arrays: feature and threshold by inner node, value by leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels y in 0, 1. Features are binned by their quantiles; each level of a tree takes one
    histogram of gradients over (node, feature, bin). Without rows, or with one label only, the score is constant."""
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    inner = 2**DEPTH - 1
    if not 0 < ones < len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    width = BINS
    flat = binned + np.arange(m) * width
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (m * width) + flat).ravel()
            shape = (wide, m, width)
            G = np.bincount(cell, np.repeat(g, m), wide * m * width).reshape(shape).cumsum(2)
            H = np.bincount(cell, np.repeat(h, m), wide * m * width).reshape(shape).cumsum(2)
            N = np.bincount(cell, minlength=wide * m * width).reshape(shape).cumsum(2)
            total_g, total_h, total_n = G[:, :, -1:], H[:, :, -1:], N[:, :, -1:]
            gain = G**2 / (H + RIDGE) + (total_g - G) ** 2 / (total_h - H + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain[(N < LEAF_ROWS) | (total_n - N < LEAF_ROWS)] = -1
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -1
            best = gain.reshape(wide, -1).argmax(1)
            for i, b in enumerate(best.tolist()):
                j, k = divmod(b, width)
                if gain[i, j, k] > 1e-6:
                    feature[first + i], threshold[first + i] = j, cuts[j][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        sums = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -RATE * sums[0] / (sums[1] + RIDGE)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Trees from the rows of `stats` (doc_id, x) that `labels` (doc_id, quality) marks 0 or 1, but those held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    rows = stats.join(known, stats["doc_id"] == known["id"]).select("x", "y", F.xxhash64("id").alias("h"), "id")
    got = rows.orderBy("h", "id", "y", "x").limit(most).select("x", "y").toPandas()
    return grow(np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES)), got["y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (of label 1, 0 to 1), predicted: one row per row of `docs`.

    Null and empty texts are scored by their statistics like others; a null doc_id is scored and not held out; repeated
    rows are scored each; labels other than 0 and 1 are ignored, and a document labelled twice counts twice. With no
    labels, or only one kind, all scores are equal. An empty table gives an empty result.
    """
    stats = cut(document_statistics(docs))
    trees = fit(stats, labels)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.scores(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def training_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Those of `docs` that `most` labels at most, of the smallest hashes of their ids, are about."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)), "doc_id", "left_semi")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be good, with the columns of `docs`.

    Statistics are taken of the labelled sample for the trees, and then of each document where it is read and scored:
    no text is shuffled and nothing is kept between.
    """
    trees = fit(document_statistics(training_documents(docs, labels)), labels)

    def good(text: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py() or b"") for t in text], np.float64).reshape(-1, len(FEATURES))
        return pa.array(trees.scores(x) >= 0.5)

    return docs.where(F.arrow_udf(good, "boolean")(F.col("text").cast("binary")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
