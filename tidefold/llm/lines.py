"""Line deduplication by deletion neighbourhoods, in DataFrame operations only.

A line is a sequence of lower-cased words. It goes if an earlier line has the same words, or, for lines of at least
NEAR_WORDS words, words within an edit distance of 1: one word replaced, inserted or deleted. Earlier is by doc_id
(nulls last), a hash of the text, and the line's number.

Equal lines meet by hash. For the edit bound every line is emitted under a hash of itself and of each variant with one
word deleted. Lines that differ by a replacement share a variant at the same place, and all lines of such a group are
within the bound of each other; lines that differ by an insertion share the shorter line itself. So the earliest line
of a group decides for all of them, found by aggregation: no pairs within a group are made. Words of each pair that is
left are compared before a line goes.

Variants are emitted for those lines only that can have a partner: an edit leaves the first or the last half of the
shorter line's words as they are, so a line without another line of equal half and fitting length has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import broadcast_if_few, keep, table, whole

NEAR_WORDS = 8
#: Lines with fewer words than this, and fewer characters (white space apart), always stay: one line may be one word,
#: as in scripts without spaces.
LEAST_WORDS, LEAST_CHARS = 3, 20
SPACE = r"[\x20\x09-\x0D]+"
#: Places of one line that are dealt to one task at most.
HOT_PLACES = 50000
#: Pairs with one best line that a task verifies, about.
STAR_ROWS = 256
#: Half keys that lines share, and repeated lines with their first places, that are sent to all tasks at most.
BROADCAST_KEYS, BROADCAST_LINES = 500000, 200000
#: Documents with candidate lines, an id and line numbers each, that are sent to all tasks at most.
BROADCAST_DOCS = 150000


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), SPACE), lambda w: w != "")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def half_key(wh: Column, m: Column, n: Column, last: int) -> Column:
    """Hash of the first m // 2 of n words' hashes, or of the last m - m // 2, with m and the side."""
    size = (F.floor(m / 2) if not last else m - F.floor(m / 2)).cast("int")
    part = F.slice(wh, n - size + 1, size) if last else F.slice(wh, F.lit(1), size)
    return F.xxhash64(part, m, F.lit(last))


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` as (kid, salt, row): a sortable id, a hash that tells rows of equal id apart, and all columns."""
    text = whole(F.col("text"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("kid"), F.xxhash64(F.col("doc_id").isNull(), text).alias("salt"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def occurrences(base: DataFrame) -> DataFrame:
    """kid, salt, line, n, own (whether the line is long enough to go), h and the four half keys (null for lines too short
    for the edit bound)."""
    lines = base.select("kid", "salt", F.posexplode(F.split(whole(F.col("row.text")), "\n")).alias("line", "text"))
    # what is said of a line's words is bound to them, so that they are split once and texts go no further
    said = lambda w: F.struct(hashes(w).alias("wh"), ((F.size(w) >= LEAST_WORDS) | (F.length(F.array_join(w, "")) >= LEAST_CHARS)).alias("own"))
    lines = lines.select("kid", "salt", "line", let(words_of(F.col("text")), said).alias("x"))
    lines = lines.select("kid", "salt", "line", F.size("x.wh").alias("n"), F.col("x.own").alias("own"), F.col("x.wh").alias("wh"))
    key = lambda less, last: F.when(F.col("n") >= NEAR_WORDS, half_key(F.col("wh"), F.col("n") - less, F.col("n"), last))
    return lines.select("kid", "salt", "line", "n", "own", F.xxhash64("wh", F.lit(-1)).alias("h"), *[key(a, b).alias(f"k{a}{b}") for a in (0, 1) for b in (0, 1)])


def place() -> Column:
    return F.struct("kid", "salt", "line")


def candidates(distinct: DataFrame) -> DataFrame:
    """h and first place of the lines that share a half key with another line."""
    near = distinct.where(F.col("n") >= NEAR_WORDS)
    keys = near.select("h", F.explode(F.array("k00", "k01", "k10", "k11")).alias("key"))
    shared = keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    return keys.join(broadcast_if_few(shared, BROADCAST_KEYS), "key").select("h").distinct().join(near.select("h", "first"), "h")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: what a lambda refers to would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs_of_xor(values: Column, n: Column) -> Column:
    """For i from 0 to n the xor of the first i of n values, in about n to the power of 1.5 steps: whole blocks of the
    square root of n values first, then what is left of a block."""
    xor = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))

    def blocked(x, size):
        every = F.sequence(F.lit(0), F.floor(n / size).cast("int"))
        at = lambda i: F.floor(i / size).cast("int")
        upto = lambda before: F.transform(F.sequence(F.lit(0), n), lambda i: F.element_at(before, at(i) + 1).bitwiseXOR(xor(F.slice(x, at(i) * size + 1, i - at(i) * size))))
        sums = lambda block: let(F.transform(every, lambda k: xor(F.slice(block, F.lit(1), k))), upto)
        return let(F.transform(every, lambda k: xor(F.slice(x, k * size + 1, size))), sums)

    size = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("int")
    return let(values, lambda x: let(size, lambda z: blocked(x, z)))


def variants(lines: DataFrame) -> DataFrame:
    """v, at (the deleted word's place, -1 for the line itself), place, h of (h, place, words).

    A sequence's hash is the xor of its words' hashes with their places, so that of a variant follows from what the
    words before the deleted one and, a place nearer, those behind it add up to."""
    wh = lines.select("h", "place", hashes(F.col("words")).alias("wh")).withColumn("n", F.size("wh"))
    stay = F.transform("wh", lambda w, i: F.xxhash64(w, i))
    move = F.transform("wh", lambda w, i: F.xxhash64(w, i - 1))
    hashed = wh.select("h", "place", "n", stay.alias("stay"), move.alias("move"))
    sums = hashed.select("h", "place", "n", F.struct(runs_of_xor(F.col("stay"), F.col("n")).alias("stay"), runs_of_xor(F.col("move"), F.col("n")).alias("move")).alias("sums"))
    sealed = lambda v, n: F.xxhash64(v, n, F.lit(-1))

    def cut_outs(x):
        without = lambda i: F.element_at(x["stay"], i + 1).bitwiseXOR(F.element_at(x["move"], -1)).bitwiseXOR(F.element_at(x["move"], i + 2))
        itself = F.struct(sealed(F.element_at(x["stay"], -1), F.col("n")).alias("v"), F.lit(-1).alias("at"))
        return F.concat(F.array(itself), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(sealed(without(i), F.col("n") - 1).alias("v"), i.alias("at"))))

    every = let(F.col("sums"), cut_outs)
    return sums.select("h", "place", F.explode(every).alias("x")).select("x.v", "x.at", "place", "h")


def within_one(a: Column, b: Column) -> Column:
    """Whether one edit of a word at most turns a into b: all but one place lies in a common start or end."""
    least = F.least(F.size(a), F.size(b))

    def common(x, y):
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int")
        return F.when(first == 0, least).otherwise(F.least(first - 1, least))

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def near_lines(base: DataFrame, distinct: DataFrame) -> DataFrame:
    """h of the distinct lines with an earlier line within the edit bound."""
    found = keep(candidates(distinct))
    want = keep(found.groupBy("first.kid", "first.salt").agg(F.collect_set("first.line").alias("want")))
    texts = base.join(broadcast_if_few(want, BROADCAST_DOCS), ["kid", "salt"])
    numbered = F.transform(F.split(whole(F.col("row.text")), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    lines = texts.select("kid", "salt", F.explode(F.filter(numbered, lambda x: F.array_contains("want", x["line"]))).alias("x"))
    lines = lines.select(F.struct("kid", "salt", F.col("x.line").alias("line")).alias("place"), words_of(F.col("x.text")).alias("words"))
    lines = keep(lines.select(F.xxhash64(hashes(F.col("words")), F.lit(-1)).alias("h"), "place", "words"))
    every = keep(variants(lines))
    # most variants are one line's own: narrow counts find those that meet another before places are aggregated
    shared = keep(every.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v"))
    v = keep(every.join(broadcast_if_few(shared, BROADCAST_KEYS), "v"))
    by_place = keep(v.groupBy("v", "at").agg(F.min(F.struct("place", "h")).alias("best"), F.count(F.lit(1)).alias("c")))
    own = F.when(F.col("at") < 0, F.col("best"))
    by_line = by_place.groupBy("v").agg(F.min(own).alias("itself"), F.min(F.when(F.col("at") >= 0, F.col("best"))).alias("longer")).where("itself IS NOT NULL AND longer IS NOT NULL")
    replaced = v.join(by_place.where("at >= 0 AND c > 1"), ["v", "at"]).select("h", "place", "best")
    inserted = v.join(by_line, "v").select("h", "place", F.when(F.col("at") < 0, F.col("longer")).otherwise(F.col("itself")).alias("best"))
    pairs = replaced.unionAll(inserted).where(F.col("best.place") < F.col("place")).select("h", F.col("best.h").alias("g")).distinct()
    pairs = keep(pairs)
    words = keep(lines.groupBy("h").agg(F.min("words").alias("words")))
    # a best line of many others is repeated, so that its pairs are dealt over tasks of about STAR_ROWS
    stars = keep(pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("k")).where("k > 1"))
    stars = broadcast_if_few(stars, BROADCAST_KEYS)
    share = lambda c, k: F.coalesce(F.col(k), F.lit(1)) if c is None else F.pmod(F.xxhash64(c, F.lit(7)), F.coalesce(F.col(k), F.lit(1))).cast("int")
    pairs = pairs.join(stars, "g", "left").select("h", "g", share("h", "k").alias("s"))
    best = words.select(F.col("h").alias("g"), F.col("words").alias("b")).join(pairs.select("g").distinct(), "g", "left_semi")
    best = best.join(stars, "g", "left").select("g", "b", F.explode(F.sequence(F.lit(0), share(None, "k") - 1)).alias("s"))
    pairs = pairs.join(words.select("h", F.col("words").alias("a")), "h").join(best, ["g", "s"])
    return pairs.where(within_one(F.col("a"), F.col("b"))).select("h").distinct()


def repeated(occ: DataFrame, lines: DataFrame) -> DataFrame:
    """The places `occ` of `lines` (h, first, c), with first. Beyond BROADCAST_LINES lines, those with more than HOT_PLACES
    places meet them where they are, and only the others' places are dealt by line."""
    if lines.count() <= BROADCAST_LINES:
        return occ.join(F.broadcast(lines.drop("c")), "h")
    hot = broadcast_if_few(keep(lines.where(F.col("c") > HOT_PLACES).drop("c")), BROADCAST_LINES)
    rest = occ.join(hot.select("h"), "h", "left_anti").join(lines.where(F.col("c") <= HOT_PLACES).drop("c"), "h")
    return occ.join(hot, "h").unionByName(rest)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(row, n_lines, n_exact, n_near, kept): all columns of `docs`, lines in all and those that went, and the rest.

    Null and empty texts have one line without words, which stays, as do all lines of fewer than LEAST_WORDS words and LEAST_CHARS characters.
    Rows equal in doc_id and text are one document and lose the same lines; null ids come last. Line ends are \\n; a
    line's other white space and letters' case don't count. A line of n words that has a candidate partner costs
    about n to the power of 1.5 steps. An empty table gives an empty result.
    """
    base = keyed(docs)
    occ = keep(occurrences(base))
    keys = [F.min(c).alias(c) for c in ("k00", "k01", "k10", "k11")]
    distinct = keep(occ.groupBy("h").agg(F.min(place()).alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("c"), F.max("own").alias("own"), *keys).where("own").drop("own"))
    near = near_lines(base, distinct)
    again = repeated(occ, keep(distinct.where("c > 1").select("h", "first", "c"))).where(place() != F.col("first"))
    exact = again.select("kid", "salt", "line", F.lit(0).alias("near"))
    also = distinct.join(near, "h").select("first.kid", "first.salt", "first.line", F.lit(1).alias("near"))
    gone = exact.unionAll(also).groupBy("kid", "salt").agg(F.collect_set(F.struct("line", "near")).alias("gone"))
    # lines of a document are few beside its text: they are hashed and texts aren't sorted
    out = base.join(gone.hint("shuffle_hash"), ["kid", "salt"], "left").select("row", F.split(whole(F.col("row.text")), "\n").alias("lines"), F.coalesce("gone", F.expr("array()")).alias("gone"))
    out = out.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone.line")))
    # collect_set keeps a line that goes for both reasons once, as exact and near never name the same place
    n_near = F.aggregate(F.col("gone.near"), F.lit(0), lambda s, x: s + x)
    kept = F.array_join(F.transform("stay", lambda i: F.element_at("lines", i + 1)), "\n")
    return out.select("row", F.size("lines").alias("n_lines"), (F.size("gone") - n_near).alias("n_exact"), n_near.alias("n_near"), kept.alias("kept"), F.size("stay").alias("n_kept"))


def strip_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with their remaining lines as text and its length as n_chars; a document that loses every
    line that isn't blank goes. Documents that lose nothing stay as they are."""
    d = dedup_lines(docs)
    lost = F.col("n_exact") + F.col("n_near") > 0
    d = d.where(~(lost & (F.trim(F.regexp_replace("kept", SPACE, " ")) == "")))
    new = {"text": F.when(lost, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(lost, F.length("kept").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return d.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_exact").cast("long").alias("n_exact"), F.col("n_near").cast("long").alias("n_near"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
w AS (SELECT doc_id, i, line, list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w FROM l),
f AS (SELECT w, min((doc_id, i)) AS first FROM w WHERE len(w) >= 3 OR length(array_to_string(w, '')) >= 20 GROUP BY w),
v AS (
  SELECT w, first, w AS v, 0 AS p FROM f WHERE len(w) >= 8
  UNION ALL
  SELECT w, first, list_slice(w, 1, p - 1) || list_slice(w, p + 1, len(w)), p FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM f WHERE len(w) >= 8)),
g AS (SELECT v, p, min(first) AS best FROM v GROUP BY v, p),
b AS (SELECT v, min(best) FILTER (WHERE p = 0) AS itself, min(best) FILTER (WHERE p > 0) AS longer FROM g GROUP BY v),
n AS (
  SELECT DISTINCT w FROM v JOIN g USING (v, p) WHERE p > 0 AND g.best < v.first
  UNION
  SELECT DISTINCT w FROM v JOIN b USING (v) WHERE (p = 0 AND b.longer < v.first) OR (p > 0 AND b.itself < v.first)),
d AS (
  SELECT w.doc_id, w.i, w.line, f.first IS NOT NULL AND (w.doc_id, w.i) <> f.first AS exact, n.w IS NOT NULL AND (w.doc_id, w.i) = f.first AS near
  FROM w LEFT JOIN f ON w.w = f.w LEFT JOIN n ON w.w = n.w)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE exact)::BIGINT AS n_exact, count(*) FILTER (WHERE near)::BIGINT AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT exact AND NOT near), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
