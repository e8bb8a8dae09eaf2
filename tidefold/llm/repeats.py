"""Exact removal of repeated passages with a sparse suffix array.

A passage is a string of SPAN bytes, or of WORDS words; bytes and words are the units, and one table holds the suffixes
of both. A passage's anchor is the position with the smallest hash among the first half's positions, so it depends on
the passage alone and equal passages have equal suffixes at their anchors. Only the suffixes at anchors are kept, one in
some 80 bytes for each unit, each with its block: the run of passages that share the anchor.

Suffixes are strings of 8-byte tokens: two leading ones (16 bytes, or the hashes of two words), a hash of what all the
block's passages share, and two of the block. Splitters sampled from documents split them into ranges of leading tokens,
ties by place, so that a passage in a third of all documents fills many ranges evenly; ranges grow in number with the
corpus, not in size. Each range is sorted by multikey quicksort and compared with its neighbours in order, and the
ranges' ends with each other:

- equal blocks (the leading tokens and 192 bits of hashes) repeat as a whole;
- neighbours that share the half after their anchors but differ elsewhere are refined: one suffix on either side is read
  again with its block, dealt by its leading tokens, and its passages are compared byte by byte. Where more than
  HOT_ROWS blocks share leading tokens, their passages are dealt one by one instead, by 128 bits of hashes.

Repeated passages are then merged by document.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import broadcast_if_few, keep, partitions, table, tidy, whole

SPAN = 400
#: Passages of over 50 words, which count where another document has them too.
WORDS = 51
GRAM = 8
#: Splitters come from at least about this many documents, and from KEYS_PER_RANGE suffixes a range.
SPLIT_DOCS, KEYS_PER_RANGE = 4000, 50
#: Suffixes of a range, about; a row has 80 bytes.
RANGE_ROWS = 1 << 19
#: Blocks of equal leading tokens that one task compares at most.
HOT_ROWS = 20000
#: Hot leading tokens, and documents with their blocks, that are sent to all tasks at most.
BROADCAST_KEYS, BROADCAST_DOCS = 200000, 100000
#: Texts are worked on in slabs of about this many bytes; a longer text is a slab of its own.
SLAB = 1 << 20
#: Segments up to this size end the quicksort.
LEAF = 256

_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Tokens of a suffix.
T = ("t0", "t1", "t2", "t3", "t4")


def words_at(data: np.ndarray, count: int) -> np.ndarray:
    """The 8 bytes at each of the first `count` positions, little-endian."""
    return np.ndarray((count,), "<u8", data, strides=(1,))


def window_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive keys, by minima of blocks from both sides."""
    n = len(key)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MUL
    h ^= h >> np.uint64(29)
    return h * _MUL2


def blocks(h: np.ndarray, n: int, ends: np.ndarray, span: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First passage, number of passages and anchor of each block, for texts of n units in all, one after another, that
    end at `ends`. h: hashes of positions; a passage's anchor is the leftmost smallest of its first `width`."""
    none = (np.zeros(0, np.int64),) * 3
    if n < span:
        return none
    room = np.uint64(max(1, int(n).bit_length()))
    h = (h >> room << room) | np.arange(len(h), dtype=np.uint64)  # hash first, place next: the leftmost smallest
    anchor = (window_argmin(h, width)[: n - span + 1] & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    at = np.flatnonzero(np.arange(len(anchor)) + span <= ends[text])
    if not len(at):
        return none
    new = np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (text[at][1:] != text[at][:-1])])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.concatenate([first, [len(at)]])), anchor[at[first]]


#: Codes of letters, and bytes that separate words.
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64)) ^ (np.arange(1, 257, dtype=np.uint64) * _MUL2)
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
BASES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def string_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the strings codes[start:stop], wherever they are; codes are uint64."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(codes) + 1)[starts])


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts one after another that end at `ends`, and each text's last word's place plus 1.
    Words are runs without ASCII white space."""
    black = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[ends] = edge[0] = True
    before = np.concatenate([[False], black[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(black & ~before)
    after = np.concatenate([black[1:], [False]]) & ~edge[1:]
    stops = np.flatnonzero(black & ~after) + 1
    return string_hashes(LETTERS[data], starts, stops), np.searchsorted(starts, ends)


def slabs(texts: pa.Array):
    """(rows, bytes, ends): consecutive non-empty texts joined to about SLAB bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) or pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, side="right")) - 1)
        stop = min(stop, len(texts))
        yield np.arange(row, stop), data[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row]
        row = stop


def block_tokens(raw: memoryview, wide: int, first, count, anchor, span: int, shared: int) -> list[np.ndarray]:
    """The third to fifth tokens of blocks, whose units have `wide` bytes: of the `shared` units after the anchor, and
    of all the block's."""
    s, e = (first * wide).tolist(), ((first + count - 1 + span) * wide).tolist()
    half = np.array([xxhash.xxh3_64_intdigest(raw[a : a + shared * wide], wide) for a in (anchor * wide).tolist()], np.uint64)
    both = b"".join([xxhash.xxh3_128_digest(raw[x:y], wide) for x, y in zip(s, e)])
    return [half, *np.frombuffer(both, ">u8").astype(np.uint64).reshape(-1, 2).T]


def suffix_rows(texts: pa.Array, span: int, words: int):
    """For each slab and unit: the unit, rows of the texts, first passage within the text, passages, five tokens."""
    for rows, data, ends in slabs(texts):
        begins = np.concatenate([[0], ends])
        if len(data) >= span:
            width = span // 2 - GRAM + 1
            first, count, anchor = blocks(mixed(words_at(data, len(data) - GRAM + 1)), len(data), ends, span, width)
            if len(first):
                big, which = words_at(data, len(data) - 7), np.searchsorted(ends, first, side="right")
                tokens = [big[anchor].byteswap(), big[anchor + 8].byteswap(), *block_tokens(memoryview(data), 1, first, count, anchor, span, span // 2)]
                yield 0, rows[which], first - begins[which], count, tokens
        if words:
            w, stops = word_hashes(data, ends)
            width = words // 2 + 1
            first, count, anchor = blocks(mixed(w), len(w), stops, words, width)
            if len(first):
                which = np.searchsorted(stops, first, side="right")
                tokens = [w[anchor], w[anchor + 1], *block_tokens(memoryview(w.view(np.uint8)), 8, first, count, anchor, words, words - width + 1)]
                yield 1, rows[which], first - np.concatenate([[0], stops])[which], count, tokens


def sort_key(tokens: list[np.ndarray]) -> np.ndarray:
    """Fixed-width strings that compare like the rows of tokens."""
    wide = np.stack(tokens, 1).astype(">u8")  # after stacking, which makes native integers
    return np.ascontiguousarray(wide).view(f"S{8 * len(tokens)}").ravel()


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of the rows. A segment is split in three around a pivot token; the middle part goes on with the next
    token, the outer parts with the same one."""
    n = len(tokens[0])
    order, stack = np.arange(n), [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(tokens):
            continue
        seg = order[lo:hi]
        if hi - lo <= LEAF:
            order[lo:hi] = seg[np.lexsort([t[seg] for t in reversed(tokens[depth:])])]
            continue
        key = tokens[depth][seg]
        pivot = np.sort(key[:: max(1, len(key) // 31)])[: 31 * 2]
        pivot = pivot[len(pivot) // 2]
        less, same = key < pivot, key == pivot
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([seg[less], seg[same], seg[~less & ~same]])
        stack += [(lo, lo + a, depth), (lo + a, lo + a + b, depth + 1), (lo + a + b, hi, depth)]
    return order


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


def place_tokens(doc_id: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (doc_id.astype(np.int64).view(np.uint64) * _MUL) ^ first.astype(np.uint64)


SUFFIX = "doc_id long, salt long, unit byte, first int, count int, " + ", ".join(f"{t} long" for t in T) + ", range int"
SUFFIX_NAMES = [x.split()[0] for x in SUFFIX.split(", ")]


def suffixes(docs: DataFrame, span: int, words: int, splitters: np.ndarray | None) -> DataFrame:
    """All suffixes of the texts of (doc_id, salt, text), with the range that the splitters put them in."""

    def run(batches):
        for batch in batches:
            ids, salt = np.asarray(batch.column("doc_id")), np.asarray(batch.column("salt"))
            for unit, row, first, count, tokens in suffix_rows(batch.column("text"), span, words):
                if splitters is None:
                    r = np.zeros(len(row), np.int32)
                else:
                    r = np.searchsorted(splitters, sort_key([*tokens, place_tokens(ids[row], first)]), side="right")
                cols = [pa.array(ids[row]), pa.array(salt[row]), pa.array(np.full(len(row), unit, np.int8)), pa.array(first, pa.int32()), pa.array(count, pa.int32()), *map(as_signed, tokens), pa.array(r, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=SUFFIX_NAMES)

    return docs.select("doc_id", "salt", "text").mapInArrow(tidy(run), SUFFIX)


def sample_splitters(docs: DataFrame, span: int, words: int) -> tuple[np.ndarray, int]:
    """Ordered keys that cut a sample of the suffixes evenly, and the number of ranges between them, which follows the
    bytes of all texts. The sample only decides how even ranges are; the driver holds KEYS_PER_RANGE keys a range."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    per_byte = 4 / span + (4 / (6 * words) if words else 0)
    ranges = max(2, partitions(docs.sparkSession), -(-int(size * per_byte) // RANGE_ROWS))
    share = min(1.0, max(SPLIT_DOCS / max(1, n), 4 * KEYS_PER_RANGE * ranges / max(1.0, size * per_byte)))
    some = docs.where(F.pmod(F.xxhash64("salt", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = suffixes(some, span, words, None).where(F.pmod(F.xxhash64("t2", "first"), F.lit(4)) == 0)
    got = got.orderBy(F.xxhash64("t3", "doc_id", "first")).limit(KEYS_PER_RANGE * ranges).toPandas()
    if not len(got):
        return np.zeros(0, f"S{8 * len(T) + 8}"), ranges
    u = [got[c].to_numpy(np.int64).view(np.uint64) for c in T]
    key = np.sort(sort_key([*u, place_tokens(got["doc_id"].to_numpy(np.int64), got["first"].to_numpy(np.int64))]))
    return np.unique(key[(np.arange(1, ranges) * len(key)) // ranges]), ranges


FOUND = f"what string, {SUFFIX}, n long, lo long, hi long"


def repeats(unit, n, lo, hi):
    """Whether a group of n equal blocks, of documents lo to hi, is a repetition: of words by documents."""
    return np.where(np.asarray(unit) == 1, np.asarray(lo) < np.asarray(hi), np.asarray(n) > 1)


def compare_ranges(dealt: DataFrame) -> DataFrame:
    """Sorts each range and compares neighbours. A row has the size and the documents of its group of equal blocks.

    Rows: 'whole' (the block repeats), 'part' (to refine), 'head' and 'tail' (of the range's first and last group, where
    it doesn't repeat within the range), and each range's 'first' and 'last' suffix. A range has about RANGE_ROWS rows.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), *[pa.int64()] * len(T), pa.int32(), *[pa.int64()] * 3]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        c = {x: t.column(x).to_numpy() for x in SUFFIX_NAMES}
        tokens = [c[x].view(np.uint64) for x in T]
        for r in np.unique(c["range"]).tolist():
            own = np.flatnonzero(c["range"] == r)
            order = own[multikey_quicksort([*(x[own] for x in tokens), place_tokens(c["doc_id"][own], c["first"][own])])]
            s = [x[order] for x in tokens]
            unit, salt = c["unit"][order], c["salt"][order]
            near = (unit[1:] == unit[:-1]) & (s[0][1:] == s[0][:-1]) & (s[1][1:] == s[1][:-1]) & (s[2][1:] == s[2][:-1])
            same = near & (s[3][1:] == s[3][:-1]) & (s[4][1:] == s[4][:-1])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            group = np.cumsum(np.concatenate([[0], ~same]))
            n, lo, hi = np.diff(np.concatenate([starts, [len(order)]])), np.minimum.reduceat(salt, starts), np.maximum.reduceat(salt, starts)
            again = repeats(unit[starts], n, lo, hi)
            alone = (unit[starts] == 1) & ~again & (n > 1)  # a document's own: all of them may meet another's
            part = np.zeros(len(order), bool)
            at = np.flatnonzero(near & ~same)
            part[at] = part[at + 1] = True
            beside = np.zeros(len(starts), bool)
            beside[group[part]] = True
            beside[[0, -1]] = True
            part |= (alone & beside)[group]
            for what, rows in (("whole", again[group]), ("part", part), ("head", ~again[group] & (group == 0)), ("tail", ~again[group] & (group == group[-1]) & (group > 0)), ("first", np.arange(len(order)) == 0), ("last", np.arange(len(order)) == len(order) - 1)):
                at = np.flatnonzero(rows)
                if len(at):
                    g = group[at]
                    cols = [*(c[x][order[at]] for x in SUFFIX_NAMES), n[g], lo[g], hi[g]]
                    yield pa.RecordBatch.from_arrays([pa.array([what] * len(at)), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=names)

    return dealt.mapInArrow(tidy(run), FOUND)


def across_boundaries(ends: list[dict]) -> tuple[list[dict], list[str]]:
    """What comparing the last suffix of each range with the first of the next adds: suffixes to refine, and the
    '<range> head' or '<range> tail' groups that repeat. `ends`: 'first' and 'last' rows."""
    by: dict[int, dict[str, dict]] = {}
    for r in ends:
        by.setdefault(r["range"], {})[r["what"]] = r
    key = lambda r, m: (r["unit"], *(r[t] for t in T[:m]))
    ranges = sorted(by)
    parts, chains = [], []  # a chain: the groups of equal blocks that follow each other over boundaries
    for i, r in enumerate(ranges):
        first, last = by[r]["first"], by[r]["last"]
        if i:
            before = by[ranges[i - 1]]["last"]
            if key(before, 3) == key(first, 3):
                parts += [before, first]
        if i and key(before, 5) == key(first, 5):
            chains[-1].append((f"{r} head", first))
        else:
            chains.append([(f"{r} head", first)])
        if key(first, 5) != key(last, 5):
            chains.append([(f"{r} tail", last)])
    whole = [name for c in chains if len(c) > 1 and repeats([c[0][1]["unit"]], [sum(x["n"] for _, x in c)], [min(x["lo"] for _, x in c)], [max(x["hi"] for _, x in c)])[0] for name, _ in c]
    return parts, whole


def window_hashes(raw: np.ndarray, starts: np.ndarray, span: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the strings of `span` units that begin at `starts`; raw: bytes, or the hashes of words."""
    return string_hashes(LETTERS[raw] if raw.dtype == np.uint8 else raw, starts, starts + span, base)


def equal_passages(raw: np.ndarray, starts: np.ndarray, span: int, owner: np.ndarray | None = None, many: np.ndarray | None = None) -> np.ndarray:
    """Which of the strings of `span` units that start at `starts` occur there more than once; with `owner`, for more
    than one owner, or where one of them has `many`. Compared by hash first, then unit by unit."""
    if not len(starts):
        return np.zeros(0, bool)
    h = window_hashes(raw, starts, span)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    view = np.lib.stride_tricks.sliding_window_view(raw, span)
    at, odd = np.flatnonzero(same), set()
    for s in range(0, len(at), 4096):
        a, b = order[at[s : s + 4096]], order[at[s : s + 4096] + 1]
        differ = (view[starts[a]] != view[starts[b]]).any(1)
        odd |= set(h[a[differ]].tolist())
    label = np.empty(len(starts), np.int64)
    label[order] = np.cumsum(np.concatenate([[0], ~same]))
    for x in odd:  # unequal strings of one hash: all of them, by their units
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(h == np.uint64(x)).tolist():
            label[i] = seen.setdefault(view[starts[i]].tobytes(), len(starts) + i)
    if odd:
        label = np.unique(label, return_inverse=True)[1]
        order = np.argsort(label, kind="stable")
    n = np.bincount(label)
    if owner is None:
        return (n > 1)[label]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    hit = np.minimum.reduceat(owner[order], begin) < np.maximum.reduceat(owner[order], begin)
    return (hit | np.logical_or.reduceat(many[order], begin))[label]


BLOCK = "doc_id long, salt long, unit byte, many boolean, first int, count int, t0 long, t1 long, t2 long, block binary"
RUN = "doc_id long, salt long, unit byte, first int, count int"


def block_windows(count: np.ndarray, lengths: np.ndarray):
    """(owner, offset, start) of each passage: its block, its place in it and its place in the joined units of blocks."""
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(count)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return owner, offset, begin[owner] + offset


def units(blocks: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The joined units of blocks, and how many each has."""
    raw = np.frombuffer(b"".join(blocks), np.uint64 if unit else np.uint8)
    return raw, np.array([len(x) for x in blocks]) // (8 if unit else 1)


def wanted(parts: DataFrame) -> DataFrame:
    """The suffixes to refine of each document."""
    one = F.struct("unit", (F.col("lo") < F.col("hi")).alias("many"), "first", "count", "t0", "t1", "t2")
    return parts.groupBy("doc_id", "salt").agg(F.collect_set(one).alias("want"))


def read_blocks(base: DataFrame, want: DataFrame, span: int, words: int) -> DataFrame:
    """The blocks of the `wanted` suffixes, as bytes or as the hashes of words."""
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.binary()]

    def read(batches):
        for batch in batches:
            for doc_id, salt, text, want in zip(*(batch.column(n) for n in ("doc_id", "salt", "text", "want"))):
                raw, asked = text.as_py(), want.as_py()
                hashes = word_hashes(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0].tobytes() if any(w["unit"] for w in asked) else b""
                cols = [[] for _ in names]
                for w in asked:
                    data, wide, size = (hashes, 8, words) if w["unit"] else (raw, 1, span)
                    row = (doc_id.as_py(), salt.as_py(), *w.values(), data[w["first"] * wide : (w["first"] + w["count"] - 1 + size) * wide])
                    for x, v in zip(cols, row):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

    # id is read for nothing here, so that texts are shuffled once, for this join and the last one
    return base.join(want, ["doc_id", "salt"]).select("id", "doc_id", "salt", "text", "want").mapInArrow(tidy(read), BLOCK)


def refine(blocks: DataFrame, span: int, words: int, ranges: int) -> DataFrame:
    """RUN: runs of passages within the blocks that occur more than once among them."""
    dealt = blocks.repartition(ranges, "t0", "t1", "t2").sortWithinPartitions("t0", "t1", "t2")
    columns = ("doc_id", "salt", "unit", "many", "first", "count", "block")

    def runs(t):
        for unit in (0, 1):
            own = [i for i, u in enumerate(t["unit"]) if u == unit]
            if not own:
                continue
            doc_id, salt, many, first, count = (np.array([t[n][i] for i in own]) for n in ("doc_id", "salt", "many", "first", "count"))
            raw, lengths = units([t["block"][i] for i in own], unit)
            owner, offset, start = block_windows(count, lengths)
            hit = equal_passages(raw, start, words if unit else span, *((salt[owner], many[owner]) if unit else ()))
            new = hit & (np.concatenate([[True], ~hit[:-1]]) | (offset == 0))
            at = np.flatnonzero(new)
            if len(at):
                length = np.bincount(np.cumsum(new)[hit] - 1)
                o = owner[at]
                cols = [pa.array(doc_id[o]), pa.array(salt[o]), pa.array(np.full(len(o), unit, np.int8)), pa.array(first[o] + offset[at], pa.int32()), pa.array(length, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RUN.split(", ")])

    def compare(batches):
        held, size, last = {n: [] for n in columns}, 0, None
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("t0", "t1", "t2"))))
            cols = {n: batch.column(n).to_pylist() for n in held}
            for i, key in enumerate(keys):
                if key != last and size > 4 << 20:
                    yield from runs(held)
                    held, size = {n: [] for n in held}, 0
                last = key
                for n in held:
                    held[n].append(cols[n][i])
                size += len(cols["block"][i])
        if size:
            yield from runs(held)

    return dealt.mapInArrow(tidy(compare), RUN)


def refine_hot(blocks: DataFrame, span: int, words: int) -> DataFrame:
    """RUN, as refine(), with one passage a row: passages are dealt, not blocks, and counted before they meet."""
    schema = "doc_id long, salt long, unit byte, many boolean, first int, w0 long, w1 long"

    def windows(batches):
        for batch in batches:
            for doc_id, salt, unit, many, first, count, block in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "salt", "unit", "many", "first", "count", "block"))):
                raw, lengths = units([block], unit)
                _, offset, start = block_windows(np.array([count]), lengths)
                w = [pa.array(window_hashes(raw, start, words if unit else span, base).view(np.int64)) for base in BASES]
                fixed = [pa.array([x] * len(offset), k) for x, k in ((doc_id, pa.int64()), (salt, pa.int64()), (unit, pa.int8()), (many, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(first + offset, pa.int32()), *w], names=[x.split()[0] for x in schema.split(", ")])

    every = keep(blocks.mapInArrow(tidy(windows), schema))
    found = every.groupBy("unit", "w0", "w1").agg(F.count(F.lit(1)).alias("n"), F.min("salt").alias("lo"), F.max("salt").alias("hi"), F.max("many").alias("any"))
    found = found.where("(unit = 0 AND n > 1) OR (unit = 1 AND (lo < hi OR any))").select("unit", "w0", "w1")
    return every.join(found, ["unit", "w0", "w1"]).select("doc_id", "salt", "unit", "first", F.lit(1).alias("count"))


def covered(first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The disjoint spans (start, stop), in order, that runs of passages of `size` units cover."""
    if not len(first):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    start = first[order].astype(np.int64)
    stop = np.maximum.accumulate(start + count[order] - 1 + size)
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return np.stack([start[new], stop[np.concatenate([new[1:], [True]])]], 1)


def remove_repeats(docs: DataFrame, span: int = SPAN, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, n_shared_words, n_shared_spans: one row per row of (doc_id, text).

    A byte goes if it is covered by a string of `span` bytes that also starts anywhere else in the input, in the same
    document or another, overlaps included; kept are the bytes that stay. n_shared_words counts the words covered by a
    run of `words` words that another document has too (0: not asked for), n_shared_spans the runs; words are told apart
    by 64-bit hashes, and nothing goes for their sake. Null and empty texts have nothing to remove; rows that repeat id
    and text, or text alone, are places of their own, so both lose all their bytes if there are `span`, but rows equal in
    both are one document; null ids are documents too. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = whole(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("id"), text.cast("binary").alias("text"))
    # rows are told apart by id and a hash of the text; rows equal in both have equal passages and fare alike
    base = base.select("id", F.coalesce("id", F.lit(0)).alias("doc_id"), F.xxhash64("id", "text", F.col("id").isNull()).alias("salt"), "text")
    least = min(span, 2 * words - 1) if words else span
    long = base.select("doc_id", "salt", "text").where(F.octet_length("text") >= least)
    splitters, ranges = sample_splitters(long, span, words)
    dealt = suffixes(long, span, words, splitters).repartitionById(ranges, F.col("range"))
    found = keep(compare_ranges(dealt))
    extra, ends = across_boundaries([r.asDict() for r in found.where("what IN ('first', 'last')").collect()])
    named = F.concat_ws(" ", F.col("range").cast("string"), "what")
    whole_blocks = found.where((F.col("what") == "whole") | named.isin(ends)).select(*[x.split()[0] for x in RUN.split(", ")])
    parts = found.where("what = 'part'").unionAll(spark.createDataFrame([tuple(r.values()) for r in extra], found.schema))
    keys = ["t0", "t1", "t2"]
    hot = keep(parts.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).select(*keys))
    if hot.count():
        hot = broadcast_if_few(hot, BROADCAST_KEYS)
        warm = keep(wanted(parts.join(hot, keys, "left_semi")))
        refined = refine_hot(read_blocks(base, broadcast_if_few(warm, BROADCAST_DOCS), span, words), span, words)
        refined = refined.unionAll(refine(read_blocks(base, wanted(parts.join(hot, keys, "left_anti")), span, words), span, words, ranges))
    else:
        refined = refine(read_blocks(base, wanted(parts), span, words), span, words, ranges)
    runs = whole_blocks.unionAll(refined)
    by_doc = runs.groupBy("doc_id", "salt").agg(F.collect_set(F.struct("unit", "first", "count")).alias("runs"))

    def strip(batches):
        for batch in batches:
            rows, every = [], batch.column("runs")
            flat, offsets = every.flatten().flatten(), np.concatenate([[0], np.cumsum(every.value_lengths().fill_null(0))])
            unit, first, count = (x.to_numpy() for x in flat)
            for text, s, e in zip(batch.column("text"), offsets[:-1].tolist(), offsets[1:].tolist()):
                raw, word = text.as_py(), unit[s:e] == 1
                gone = covered(first[s:e][~word], count[s:e][~word], span)
                shared = covered(first[s:e][word], count[s:e][word], words)
                kept = b"".join(raw[x:y] for (_, x), (y, _) in itertools.pairwise([(0, 0), *gone.tolist(), (len(raw), 0)])) if len(gone) else raw
                rows.append((len(raw), len(raw) - len(kept), len(gone), kept, int((shared[:, 1] - shared[:, 0]).sum()), len(shared)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared_words", "n_shared_spans"])

    whole_rows = base.join(by_doc, ["doc_id", "salt"], "left").select("id", "doc_id", "salt", "text", "runs")
    return whole_rows.mapInArrow(tidy(strip), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared_words long, n_shared_spans long")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words", "n_shared_spans")
