"""Document fingerprints by I-Match, in DataFrame operations only.

Terms are lower-cased words, told apart by 64-bit hashes; the lexicon is those whose share of documents lies within the
band. It is bounded for any corpus: a document's terms are one in BAND[0] times n at most, so that the lexicon has no
more terms than 1 / BAND[0] times the mean number of distinct terms. A text's distinct lexicon terms are sorted, and
randomised subsets of the lexicon each hash those that fall in them. Subsets must be sparse enough that an edit leaves some of them alone and
dense enough to hold a term, so their density follows the text's number of lexicon terms: a text with 2^c to 2^(c+1)
terms takes SUBSETS subsets with density 2^-c and as many with 2^-(c+1). Texts that differ less than twice in terms so
have subsets of one density to compare. Likeness is the share of equal hashes among the subsets that either text has
terms in. A text without a lexicon term has the hash of all its distinct terms instead.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import cut, partitions, table, whole

#: Terms in at least this share of documents, and in at most that one, are the lexicon.
BAND = (1 / 500, 1 / 10)
SUBSETS = 16
SPACE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Distinct hashes of the words, sorted."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda t: t != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda t: F.xxhash64(t))))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[list[int]]:
    """The terms whose share of the documents is within the band, in a power of two buckets by their low bits."""
    n = docs.count()
    counts = docs.select(F.explode(terms(whole(F.col("text")))).alias("term")).groupBy("term").count()
    found = [r[0] for r in counts.where((F.col("count") >= band[0] * n) & (F.col("count") <= max(1.0, band[1] * n))).select("term").collect()]  # bounded, see above
    buckets: list[list[int]] = [[] for _ in range(1 << max(4, len(found).bit_length() - 1))]
    for t in sorted(found):
        buckets[t & (len(buckets) - 1)].append(t)
    return buckets


def fingerprints(rows: DataFrame, text: str, buckets: list[list[int]], out: str) -> DataFrame:
    """`rows` with column `out` added: the fingerprint of column `text` (not null)."""
    lex = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")  # folded into a constant
    in_lexicon = lambda x: F.array_contains(F.element_at(lex, x.bitwiseAND(F.lit(len(buckets) - 1)).cast("int") + 1), x)
    short = lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    rows = rows.withColumn("_terms", terms(F.col(text)))
    rows = rows.withColumn("_mixed", F.transform(F.filter("_terms", in_lexicon), lambda x: F.xxhash64(x, F.lit(1))))
    n = F.size("_mixed")
    rows = rows.withColumn("_c", F.when(n > 0, F.floor(F.log2(n.cast("double"))).cast("int")).otherwise(-1))
    for level, name in ((0, "_a"), (1, "_b")):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("_c"), F.lit(0)) + level) - 1
        rows = rows.withColumn("_mask", mask).withColumn("_some", F.filter("_mixed", lambda v: v.bitwiseAND(F.col("_mask")) < SUBSETS))
        one = lambda k: F.filter("_some", lambda v: v.bitwiseAND(F.col("_mask")) == k)
        subsets = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)
        rows = rows.withColumn(name, F.transform(subsets, lambda s: F.when(F.size(s) > 0, short(F.xxhash64(s))).otherwise(-1)))
    every = F.array(short(F.xxhash64("_terms")))
    struct = F.struct("_c", F.when(F.col("_c") < 0, every).otherwise(F.col("_a")).alias("a"), F.when(F.col("_c") < 0, every).otherwise(F.col("_b")).alias("b"))
    struct = struct.cast("struct<c:int,a:array<int>,b:array<int>>")
    return rows.withColumn(out, struct).drop("_terms", "_mixed", "_c", "_mask", "_some", "_a", "_b")


def likeness(f: Column, g: Column) -> Column:
    """Between 0 and 1; 1 for equal fingerprints."""
    pick = lambda x: F.when(f["c"] == g["c"], F.concat(x["a"], x["b"]))
    x = pick(f).when(f["c"] == g["c"] + 1, f["a"]).when(f["c"] + 1 == g["c"], f["b"])
    y = pick(g).when(f["c"] == g["c"] + 1, g["b"]).when(f["c"] + 1 == g["c"], g["a"])
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.greatest(p["x"], p["y"]) >= 0)
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    apart = (f["c"] < 0) != (g["c"] < 0)
    return F.when(apart | (F.abs(f["c"] - g["c"]) > 1), 0.0).otherwise(F.coalesce(same.cast("double") / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0)))


def written(f: Column) -> Column:
    digits = lambda a: F.array_join(F.transform(a, lambda v: F.when(v < 0, "-").otherwise(F.lpad(F.lower(F.hex(v)), 8, "0"))), "")
    return F.concat_ws(":", f["c"].cast("string"), digits(f["a"]), digits(f["b"]))


def previous(keys: DataFrame, n: int) -> DataFrame:
    """For each distinct (kid, salt, doc_id, n_chars) the row that it follows in descending doc_id, nulls last, then
    salt; the first follows the last. Rows are dealt in ranges of that order; only ranges' ends meet."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("salt")]
    dealt = cut(cut(keys.distinct()).repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("range").orderBy(*order)
    was = F.struct("kid", "salt", "doc_id", "n_chars")
    last_first = dealt.select("range", was.alias("row"), F.row_number().over(Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), F.col("salt").desc())).alias("i"))
    last = last_first.where("i = 1").select("range", "row")
    ends = Window.orderBy("range")
    edge = last.select(F.col("range").alias("r"), F.coalesce(F.lag("row").over(ends), F.last("row").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    rows = dealt.withColumn("before", F.lag(was).over(own)).join(F.broadcast(edge), F.col("range") == F.col("r"))  # a row a range
    return rows.select("kid", "salt", F.coalesce("before", "edge").alias("p"))


def compare_edited(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of (doc_id, text).

    The edited text has its last third of code points replaced by the first as many of the next document's, in
    descending doc_id; nulls come last, equal ids by a hash of their texts, rows equal in id and text are one document
    and are answered each; the last document's next is the first, and a single document's next is itself. Null texts
    are empty; texts without words have the fingerprint of no terms and likeness 1 to each other. An empty table gives
    an empty result.
    """
    n = partitions(docs.sparkSession)
    text = whole(F.col("text"))
    lex = lexicon(docs, band)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("kid"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("salt"), "text")
    before = previous(base.select("kid", "salt", "doc_id", F.length("text").cast("long").alias("n_chars")), n)
    own = fingerprints(base.select("kid", "salt", "text"), "text", lex, "f")
    given = own.join(before, ["kid", "salt"]).select(
        F.col("p.kid").alias("kid"), F.col("p.salt").alias("salt"), F.col("p.doc_id").alias("doc_id"),
        F.substring("text", F.lit(1), F.floor(F.col("p.n_chars") / 3).cast("int")).alias("piece"), F.col("f").alias("next"),
    )
    given = given.withColumn("i", F.row_number().over(Window.partitionBy("kid", "salt").orderBy("doc_id"))).where("i = 1").drop("i")
    both = own.join(given, ["kid", "salt"]).withColumn("n_chars", F.length("text").cast("long"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int"))
    both = fingerprints(both.select("doc_id", "n_chars", "f", "next", F.concat(kept, "piece").alias("edited")), "edited", lex, "g")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("f")).alias("fingerprint"),
        written(F.col("g")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next")).alias("near_next"),
    )


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
