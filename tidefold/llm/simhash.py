"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated fingerprint bits are grouped into partitions, so that skew collects in few of them. Partition thresholds
t_i with sum(t_i) = t - m + 1, each at least -1 (not probed at all), leave no pair within t bits undiscovered: if every
partition differed by more than its t_i the pair would differ by more than t. Dynamic programming picks the thresholds
with the fewest estimated candidates, over several numbers m of partitions. Distinct fingerprints meet in buckets of
equal masked bits, where the pairs are verified by bit counts; a bucket returns a spanning star for each of its linked
sets, not its pairs. Copies share a fingerprint and take part once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import broadcast_if_few, cut, keep, table, tidy
from tidefold.llm.links import components

SEED = 42
#: Partitions and thresholds are planned on about this many fingerprints at most; results don't depend on the plan.
PLAN_ROWS = 20000
#: Buckets up to this size are compared by shifts of the sorted rows, larger ones by blocks or by flipping bits.
SMALL = 48
#: Fingerprints that are linked or of several documents, with their component, that are sent to all tasks at most.
BROADCAST_LINKED = 500000
#: Dropped documents, an id and a hash each, that are sent to all tasks at most.
BROADCAST_DROPS = 200000


def fingerprint(raw: bytes, width: int, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """64 bits for each seed; a bit is 1 if more than half of the shingles' hashes have it. No words: 0."""
    words = raw.lower().split()  # ASCII only, both of them
    if not words:
        return [0] * len(seeds)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    out = []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 65536):
            h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, width: int, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id, salt (a hash of the text), fp and more: 64 bits as signed longs of whole texts, fp of the first seed and
    more of the second or 0. Null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py() or b"", width, seeds) for x in batch.column("text")], np.uint64).reshape(-1, len(seeds)).view(np.int64)
            more = fp[:, 1] if len(seeds) > 1 else np.zeros(len(fp), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("salt"), pa.array(np.ascontiguousarray(fp[:, 0])), pa.array(np.ascontiguousarray(more))], names=["doc_id", "salt", "fp", "more"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_salt().alias("salt"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, salt long, fp long, more long")


def text_salt():
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


# planning


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the columns, alike in size, the most correlated columns together."""
    width = bits.shape[1]
    x = bits - bits.mean(0)
    norm = np.sqrt((x * x).sum(0)) + 1e-9
    alike = np.abs(x.T @ x) / np.outer(norm, norm)
    skew = np.abs(bits.mean(0) - 0.5)
    left, parts = set(range(width)), []
    for i in range(m):
        want = -(-len(left) // (m - i))
        part = [max(sorted(left), key=lambda c: skew[c])]
        left.discard(part[0])
        while len(part) < want:
            best = max(sorted(left), key=lambda c: alike[c, part].sum() + skew[c])
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def estimated_pairs(values: np.ndarray, part: list[int], most: int) -> list[float]:
    """For thresholds -1, 0 .. most: the sample's pairs that differ by no more bits within the partition."""
    mask = np.uint64(sum(1 << b for b in part))
    v, n = np.unique(values & mask, return_counts=True)
    out = [0.0, float((n * (n - 1) // 2).sum())]
    for t in range(1, most + 1):
        extra = 0.0
        flips = [sum(1 << b for b in c) for c in itertools.combinations(part, t)]
        for x in flips[:600]:
            at = np.minimum(np.searchsorted(v, v ^ np.uint64(x)), len(v) - 1)
            hit = v[at] == v ^ np.uint64(x)
            extra += float((n[hit] * n[at[hit]]).sum()) / 2
        out.append(out[-1] + extra * max(1.0, len(flips) / 600))
    return out


def keys_per_row(part: list[int], t: int) -> int:
    return sum(len(list(itertools.combinations(part, k))) for k in range(t + 1)) if t >= 0 else 0


def plan(sample: np.ndarray, threshold: int, times: float, rows: int) -> list[tuple[list[int], int]]:
    """Partitions with thresholds. `times`: rows per sampled row. A candidate pair costs as much as 1/20 key."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    best = None
    for m in range(2, min(6, threshold + 2) + 1 if threshold > 2 else 5):
        goal = threshold - m + 1
        parts = group_bits(bits, m)
        most = min(threshold, 2)
        costs = []
        for p in parts:
            pairs = estimated_pairs(sample, p, most)
            costs.append([pairs[t + 1] * times * times / 20 + rows * keys_per_row(p, t) for t in range(-1, most + 1)])
        table = {0: (0.0, [])}
        for c in costs:
            step: dict = {}
            for (total, (cost, picks)), t in itertools.product(table.items(), range(-1, most + 1)):
                new = (cost + c[t + 1], [*picks, t])
                if total + t not in step or new < step[total + t]:
                    step[total + t] = new
            table = step
        if goal in table and (best is None or table[goal][0] < best[0]):
            best = (table[goal][0], list(zip(parts, table[goal][1])))
    if best is None:
        raise ValueError(f"no plan for {threshold} bits")
    return best[1]


# probing


def joined_sets(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest reachable index of each of n nodes, by hooking and pointer jumping."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def small_links(key, fp, more, t: int, all_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of rows (sorted by key) with equal keys, row i with i + 1, i + 2 and so on."""
    found_a, found_b = [], []
    at = np.arange(len(key) - 1)
    for shift in range(1, len(key)):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            break
        near = apart(fp[at], fp[at + shift])
        hit = at[near <= t]
        hit = hit[near[near <= t] + apart(more[hit], more[hit + shift]) <= all_bits]
        found_a.append(hit)
        found_b.append(hit + shift)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def large_labels(fp, more, t: int, all_bits: int) -> np.ndarray:
    """Smallest reachable index within one bucket. Where fingerprints are distinct, sorted and have no more bits, it is
    linear in their number for t up to 2: each is looked up with all its flips. Else pairs are compared, in blocks, but
    for those that are connected already."""
    n, label = len(fp), None
    if t <= 2 and n > 4000 and not more.any() and (fp[1:] > fp[:-1]).all():
        flips = [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in itertools.combinations(range(64), 2)] * (t == 2)
        for x in flips if t else []:
            other = fp ^ np.uint64(x)
            at = np.minimum(np.searchsorted(fp, other), n - 1)
            hit = np.flatnonzero(fp[at] == other)
            if len(hit):
                label = joined_sets(n, hit, at[hit], label)
        return np.arange(n) if label is None else label
    many, label = max(1, min(256, (1 << 18) // n)), np.arange(n)
    for s in range(0, n, many):
        rows, others = np.arange(s, min(s + many, n)), np.arange(s, n)
        if (label[rows] == label[s]).all():  # what is connected already isn't compared
            others = others[label[others] != label[s]]
        if not len(others):
            continue
        a, b = np.nonzero(apart(fp[rows, None], fp[None, others]) <= t)
        a, b = rows[a], others[b]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        ok = apart(fp[a], fp[b]) + apart(more[a], more[b]) <= all_bits
        if ok.any():
            label = joined_sets(n, a[ok], b[ok], label)
    return label


def probe(t: int, all_bits: int):
    """Links from rows (part, value, id, fp, more) sorted by part and value, whole buckets in a partition."""

    def stars(part, value, ids, fp, more):
        change = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1
        starts = np.concatenate([[0], change])
        size = np.diff(np.concatenate([starts, [len(fp)]]))
        key = np.repeat(np.arange(len(starts)), size)
        many = (size[key] > 1) & (size[key] <= SMALL)
        i = ids[many]
        a, b = small_links(key[many], fp[many], more[many], t, all_bits)
        out = [(i, i[joined_sets(len(i), a, b)])]
        for g in np.flatnonzero(size > SMALL):
            rows = np.arange(starts[g], starts[g] + size[g])
            rows = rows[np.argsort(fp[rows], kind="stable")]
            out.append((ids[rows], ids[rows][large_labels(fp[rows], more[rows], t, all_bits)]))
        x, y = (np.concatenate(z) for z in zip(*out))
        return x[x != y], y[x != y]

    def run(batches):
        held: list[list[np.ndarray]] = []  # of one key, or the last rows so far
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [np.asarray(batch.column(i)) for i in range(5)]
                if not len(now[0]):
                    continue
                held.append(now)
                if (now[0][-1], now[1][-1]) == (held[0][0][0], held[0][1][0]):  # rows are sorted: all of one key
                    continue
            if not held:
                return
            rows = [np.concatenate(z) for z in zip(*held)]
            upto = len(rows[0])
            if batch is not None:
                upto = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1
            held = [[z[upto:] for z in rows]] if upto < len(rows[0]) else []
            part, value, ids, fp, more = (z[:upto] for z in rows)
            x, y = stars(part, value, ids, fp.view(np.uint64), more.view(np.uint64))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, threshold: int, all_bits: int = 128) -> DataFrame:
    """(a, b): ids of linked rows of `distinct` (id, fp, more), enough of them to connect all that are linked.

    Linked are rows whose fp differ by at most `threshold` bits, and fp and more together by at most `all_bits`.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    every = max(1, -(-rows // PLAN_ROWS))
    got = distinct.where(F.pmod(F.xxhash64(F.xxhash64("fp")), F.lit(every)) == 0).select("fp").collect()
    sample = np.array([r[0] for r in got] or [0], np.int64).view(np.uint64)
    keys = []
    for i, (part, t) in enumerate(plan(sample, threshold, every, rows)):
        mask = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in part))))
        for k in range(t + 1):
            for c in itertools.combinations(part, k):
                keys.append(F.struct(F.lit(i).alias("part"), mask.bitwiseXOR(F.lit(signed(sum(1 << b for b in c)))).alias("value")))
    spread = distinct.select("id", "fp", "more", F.explode(F.array(*keys)).alias("key")).select("key.part", "key.value", "id", "fp", "more")
    dealt = spread.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "value").sortWithinPartitions("part", "value")
    return dealt.mapInArrow(tidy(probe(threshold, all_bits)), "a long, b long")


def near_duplicates(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, fp, component_id: one row per row of (doc_id, text).

    Fingerprints within `threshold` bits are linked; component_id is the smallest doc_id of those reachable. Null and
    empty texts have fingerprint 0 and are linked like any other; repeated rows and ids are answered each; a null
    doc_id is never the smallest unless a component has no other, then the component is null. An empty table gives an
    empty result.
    """
    fps = cut(fingerprints(docs, width).select("doc_id", "fp"))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select(F.col("fp").alias("id"), "fp", F.lit(0).cast("long").alias("more")), threshold))
    own = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("m"))
    # a document alone is its own component: only the fingerprints of larger ones meet the documents
    by_fp = keep(own.join(least.where("m > 1"), "root").select(F.col("fp").alias("f"), F.struct("component_id").alias("c")))
    found = fps.join(broadcast_if_few(by_fp, BROADCAST_LINKED), F.col("fp") == F.col("f"), "left")
    return found.select("doc_id", "fp", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("c.component_id")).alias("component_id"))


#: Corpus deduplication: near duplicates are texts whose sets of five-word shingles have a Jaccard similarity of at least
#: 0.8 (9 * shared >= 4 * (one + other), in integers), or that others of the kind connect. Candidates are pairs with one of
#: BANDS bands of BAND_ROWS minimal hashes in common: all but 5 in 10 million of the pairs at 0.8, fewer above, and of pairs
#: that share little next to none, so that the candidates of a text don't grow with the corpus.
WIDTH, BANDS, BAND_ROWS = 5, 48, 6
MINIMA = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND_ROWS), np.uint32) | np.array([[0], [1]], np.uint32)
#: Shingles of one side of a task of comparisons, about; larger groups of candidates are compared block by block.
BLOCK_SHINGLES = 500000
#: Candidates' places, an id and two hashes each, that are sent to all tasks at most.
BROADCAST_CANDIDATES = 200000


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of all words where they are fewer than a shingle's."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, ends = (ends - sizes)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n))


def band_keys(h: np.ndarray) -> np.ndarray:
    """A hash for each band of minimal hashes, of 32 bits each; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    h, least = h.astype(np.uint32), np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    room = np.empty((min(len(h), 512), len(least)), np.uint32)
    for at in range(0, len(h), 512):
        some = room[: len(h) - at]
        np.bitwise_xor(h[at : at + 512, None], MINIMA[0], out=some)
        np.multiply(some, MINIMA[1], out=some)
        np.minimum(least, some.min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, salt, s1 and s2 (a hash of the set of shingles), n (its size), bands of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                h = shingle_set(x.as_py() or b"", WIDTH)
                s = [signed(xxhash.xxh64_intdigest(h.tobytes(), seed)) for seed in (0, 1)]
                rows.append((*s, len(h), band_keys(h)))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("salt"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "salt", "s1", "s2", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_salt().alias("salt"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, salt long, s1 long, s2 long, n long, bands array<long>")


def similar_links(ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near duplicates, enough to connect all that are: of rows of different blocks if `across`, else of all.
    Rows that are connected already aren't compared; one row's others are counted in one pass over their shingles."""
    order = np.argsort(block, kind="stable")
    ids, sets, block = ids[order], [sets[i] for i in order], block[order]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    own = [codes[s:e] for s, e in zip(starts, starts[1:])]
    mark, label = np.zeros(len(codes), bool), np.arange(len(ids))
    found = []

    def join(i, hits):
        for j in hits.tolist():
            if label[i] != label[j]:
                found.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]

    for i in range(len(ids) - 1):
        first = int(np.searchsorted(block, block[i], "right")) if across else i + 1
        if first == len(ids):
            break
        least = np.minimum(size[first:], size[i])
        open_ = lambda: first + np.flatnonzero((label[first:] != label[i]) & (9 * least >= 4 * (size[first:] + size[i])))  # noqa: B023, E731
        mark[own[i]] = True
        near = lambda j: 9 * int(mark[own[j]].sum()) >= 4 * (size[i] + size[j])  # noqa: B023, E731
        rest, tried = open_(), 0
        while len(rest) and tried < 4:
            if near(rest[0]):
                join(i, rest[:1])
                rest = open_()
            else:
                rest = rest[1:]
            tried += 1
        if len(rest) * 8 > len(ids) - first:
            upto = np.concatenate([[0], np.cumsum(mark[codes])])
            shared = upto[starts[rest + 1]] - upto[starts[rest]]
            join(i, rest[9 * shared >= 4 * (size[i] + size[rest])])
        elif len(rest):
            join(i, rest[[near(j) for j in rest]])
        mark[own[i]] = False
    none = np.zeros(0, np.int64)
    return (none, none) if not found else tuple(np.array(found, np.int64).T)


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b): ids of rows of `distinct` (id, bands) with a band in common, the smallest of each band with the others."""
    keys = distinct.select("id", F.explode("bands").alias("band"))
    stars = keys.groupBy("band").agg(F.min("id").alias("b"), F.max("id").alias("c")).where("b < c").select("band", "b")
    return keys.join(stars, "band").select(F.col("id").alias("a"), "b").where("a <> b")


def verified(docs: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): links of near duplicates among rows of `distinct` that `groups` (node, root) holds as candidates of each
    other. Sets of shingles are made again, for candidates only; a group of k blocks is compared in k * (k + 1) / 2 tasks."""
    members = distinct.join(groups.unionAll(groups.select(F.col("root").alias("node"), "root").distinct()), F.col("id") == F.col("node"))
    members = keep(members.select("id", "root", "n", F.col("first.kid").alias("_sh_k"), F.col("first.salt").alias("_sh_s")))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("k"))
    places = keep(members.join(blocks, "root").select("id", "root", F.greatest("k", F.lit(1)).alias("k"), "_sh_k", "_sh_s"))

    def read(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py() or b"", WIDTH).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), batch.column("k"), pa.array(sets, pa.binary())], names=["id", "root", "k", "set"])

    texts = docs.select(sort_id().alias("_sh_k"), text_salt().alias("_sh_s"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(broadcast_if_few(places, BROADCAST_CANDIDATES), ["_sh_k", "_sh_s"]).select("id", "root", "k", "text")
    sets = texts.mapInArrow(tidy(read), "id long, root long, k int, set binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiles = sets.select("id", "root", "block", "set", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def compare(tile: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in tile.column("set")]
        across = tile.column("x")[0].as_py() != tile.column("y")[0].as_py()
        a, b = similar_links(tile.column("id").to_numpy(), sets, tile.column("block").to_numpy(), across)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy("root", "x", "y").applyInArrow(compare, "a long, b long")


def sort_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but for near duplicates, of which the one with the smallest doc_id stays (nulls last, then by
    a hash of the text; of rows equal in both one stays).

    Documents of equal sets of shingles take part once, those without words are near duplicates of each other.
    Candidates are connected by links of bands; within a group of them, near duplicates are connected by links that are
    verified. The rows to drop meet the documents where these are read if there are at most
    BROADCAST_DROPS, else in a shuffled anti-join.
    """
    fps = keep(sketches(docs))
    key = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("kid"), "salt")
    distinct = fps.groupBy("s1", "s2").agg(F.min(key).alias("first"), *[F.first(c).alias(c) for c in ("n", "bands")])
    distinct = keep(distinct.withColumn("id", F.monotonically_increasing_id()))
    roots = keep(components(keep(verified(docs, distinct, keep(components(candidates(distinct)))))))
    own = distinct.join(roots, distinct["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    least = own.groupBy("root").agg(F.min("first").alias("stays"))
    stays = own.join(least, "root").select("s1", "s2", "stays")
    gone = fps.join(stays, ["s1", "s2"]).select(key.alias("k"), "stays").where("k <> stays")
    gone = keep(gone.select("k.kid", "k.salt").distinct())
    rows = docs.withColumn("_sh_k", sort_id()).withColumn("_sh_s", text_salt())
    gone = broadcast_if_few(gone.select(F.col("kid").alias("_sh_k"), F.col("salt").alias("_sh_s")), BROADCAST_DROPS)
    rows = rows.join(gone, ["_sh_k", "_sh_s"], "left_anti")
    if fps.groupBy("doc_id", "salt").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["_sh_k", "_sh_s"])
    return rows.select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), 3, 2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
