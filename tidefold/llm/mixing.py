"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key, -ln(u) / w, with u from a hash of its id and text and w its quality weight. A
source takes as many complete epochs as fit its target, then the documents with the smallest keys as long as they fit
the rest, and then the one other document that brings it nearest to its target, if any does. The cut is found without
sorting whole sources: keys fall into a fixed number of ordered cells, cell totals are prefix-summed, the one cell in
which a source's budget ends is divided once more, and only some ten thousandths of a source's keys are sorted. What a
document is then taken for follows from its key and its source's cut, so no text is ever shuffled and a source with a
third of all rows is no heavier per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import cut, table, whole, word_count
from tidefold.operators.scans import running

CELLS = 1024
#: A row per source of 5 numbers and a name: up to so many are broadcast.
BROADCAST_SOURCES = 50000
SYMBOLS = r"[!#$%&*+/<=>@\\^_`{|}~]"


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1, less for texts full of symbols; 1 for an empty text."""
    share = F.regexp_count(whole(text), F.lit(SYMBOLS)) / F.greatest(F.length(whole(text)), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * share)


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """Exponential with rate `weight`; the same for every run. Rows of equal id and text tie."""
    drawn = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(whole(text).cast("binary")))
    u = (F.conv(F.substring(F.md5(drawn.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """source, source_size, target. `sizes`: one row (source, source_size) per source.

    Sources in order of code points, nulls last, take the weights in turn. The shares of all sizes that exceed `cap`
    times their source are cut there and the excess is shared again by weight: target = least(cap * size, x * weight)
    for the one x at which the targets add up, found in order of cap * size / weight. Sums over the sources are split
    over ranges where these are many.
    """
    s = cut(sizes.select("source", "source_size", F.lit(0).alias("one"), F.struct(F.col("source").isNull().alias("null"), "source").alias("name")))
    n, total = s.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    s = running(s, ["one"], "name", {"place": F.lit(1)}, most=n)
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    s = s.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    s = cut(s.withColumn("order", F.struct("ratio", "place")))
    s = running(s, ["one"], "order", {"limits": F.col("limit"), "weights": F.col("weight")}, most=n)
    every = s.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    s = cut(s.withColumn("level", (F.lit(total).cast("double") - (F.col("limits") - F.col("limit"))) / (F.lit(every) - F.col("weights") + F.col("weight"))))
    x = s.where(F.col("level") <= F.col("ratio")).agg(F.min_by("level", "order")).first()[0] or 0.0
    return s.select("source", "source_size", F.least("limit", F.lit(x) * F.col("weight")).alias("target"))


def ending(totals: DataFrame, cell: str, begin: DataFrame) -> DataFrame:
    """source, cell, before, rest: the cell in which a source's budget `rest` ends, with what is taken before it.

    `totals`: (source, cell, cell_size); `begin`: (source, before, rest), what is taken before all these cells.
    """
    from_source = begin.select(F.col("source").alias("s"), F.col("before").alias("b"), "rest")
    prior = F.sum("cell_size").over(Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    summed = totals.withColumn("prior", F.coalesce(prior, F.lit(0))).join(from_source, F.col("source").eqNullSafe(F.col("s")))
    summed = summed.withColumn("before", F.col("b") + F.col("prior"))
    ends = summed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("cell_size") >= F.col("rest")))
    return ends.select("source", cell, "before", "rest")


def of_ends(celled: DataFrame, cell: str, ends: DataFrame) -> DataFrame:
    """The rows of the cells in which budgets end."""
    at = ends.select(F.col("source").alias("s"), F.col(cell).alias("c"))
    return celled.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col(cell) == F.col("c"))).drop("s", "c")


def budgets(keyed: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """One row per source: source, source_size, target, epochs, cut (the largest key taken once more, or less than any)
    and extra (the key taken besides, or null)."""
    # octaves of the key, each in as many cells: as fine for the lowest weights as for 1
    fine = F.floor((F.log2(F.greatest(F.col("key"), F.lit(2.0**-47))) + F.lit(48.0)) * F.lit(CELLS * CELLS / 64))
    fine = F.least(F.lit(CELLS * CELLS - 1), fine).cast("int")
    celled = keyed.select("source", "size", "key", fine.alias("fine")).withColumn("cell", F.floor(F.col("fine") / CELLS).cast("int"))
    totals = cut(celled.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    targets = source_targets(totals.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, cap)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = cut(targets)
    begin = targets.select("source", F.lit(0).cast("long").alias("before"), "rest")
    ends = ending(totals, "cell", begin)
    inner = of_ends(celled, "cell", ends).groupBy("source", "fine").agg(F.sum("size").alias("cell_size"))
    ends = cut(ending(inner, "fine", ends))
    last = of_ends(celled, "fine", ends).join(ends.select(F.col("source").alias("s"), "before", "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ties = last.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("size"))
    ties = ties.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    fits = lambda c: F.max(F.when(F.col("upto") <= F.col("rest"), F.col(c)))
    # where nothing of the last cell is taken, the cut lies just below its smallest key
    cuts = ties.groupBy(F.col("source").alias("s")).agg(F.coalesce(fits("key"), F.min("key") * F.lit(1 - 1e-15)).alias("cut"), F.coalesce(fits("upto"), F.min("before")).alias("used"))
    out = targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = cut(out.select("source", "source_size", "target", "epochs", F.coalesce("cut", F.lit(-1.0)).alias("cut"), (F.col("rest") - F.coalesce("used", F.lit(0))).alias("left")))
    # the one document beside these with which the source comes nearest; rows that tie are taken together or not at all
    short = few(out.where("left > 0").select(F.col("source").alias("s"), F.col("cut").alias("c"), "left"))
    others = keyed.join(short, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") > F.col("c")) & (F.col("size") > 0))
    gap = F.abs(F.col("left") - F.col("size"))
    best = few(others.where(gap < F.col("left")).groupBy("s", "left").agg(F.min(F.struct(gap.alias("gap"), "key")).alias("x")).select("s", "left", F.col("x.key").alias("extra")))
    same = keyed.join(best, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("extra"))).groupBy("s", "left", "extra").agg(F.sum("size").alias("size"))
    extra = same.where(gap < F.col("left")).select("s", "extra")
    return out.join(extra, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut", "extra")


def times_taken(key: Column, epochs: Column, upto: Column, extra: Column) -> Column:
    """How often a document is taken."""
    return epochs + ((key <= upto) | F.coalesce(key == extra, F.lit(False))).cast("long")


def few(by: DataFrame) -> DataFrame:
    """Sent to all tasks where it has at most BROADCAST_SOURCES rows, counted first; else left to a sort merge join."""
    by = cut(by)
    return F.broadcast(by) if by.count() <= BROADCAST_SOURCES else by


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, quality=quality_weight) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document of (doc_id, text, source).

    Sizes are words. A null text or one without words has size 0 and is taken with its key like any other; a null
    source is a source; null ids are told apart by their texts; rows equal in id and text tie and are taken together.
    An empty table gives an empty result.
    """
    keyed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), sampling_key(F.col("doc_id"), F.col("text"), quality(F.col("text")), seed).alias("key"))
    keyed = cut(keyed)
    by = few(budgets(keyed, weights, cap).withColumnRenamed("source", "s"))
    joined = keyed.join(by, F.col("source").eqNullSafe(F.col("s")))
    copies = times_taken(F.col("key"), F.col("epochs"), F.col("cut"), F.col("extra"))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as mix_sources() takes it, with the columns of `docs`."""
    key = sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed)
    keyed = cut(docs.select("source", word_count(F.col("text")).alias("size"), key.alias("key")))
    by = budgets(keyed, weights, cap).select(F.col("source").alias("_mix_s"), F.col("epochs").alias("_mix_e"), F.col("cut").alias("_mix_c"), F.col("extra").alias("_mix_x"))
    by = few(by)
    joined = docs.withColumn("_mix_k", key).join(by, F.col("source").eqNullSafe(F.col("_mix_s")))
    copies = times_taken(F.col("_mix_k"), F.col("_mix_e"), F.col("_mix_c"), F.col("_mix_x"))
    taken = joined.withColumn("_mix_n", copies.cast("int")).where("_mix_n > 0")
    return taken.withColumn("_mix_i", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*docs.columns)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


OP3_SQL = r"""
WITH k AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17:' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (len(regexp_extract_all(coalesce(text, ''), '[!#$%&*+/<=>@\\^_`{|}~]'))
                    / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM k GROUP BY source),
w AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS lim FROM s),
l AS (
  SELECT *, lim / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY lim / weight, place) AS rk
  FROM w),
x AS (SELECT coalesce(arg_min(level, rk) FILTER (WHERE level <= ratio), 0) AS x FROM l),
t AS (SELECT source, source_size, least(lim, x * weight) AS target FROM l, x),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (
  SELECT source, any_value(rest) AS rest, coalesce(max(key) FILTER (WHERE rest > 0 AND upto <= rest), -1) AS cut, coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS used
  FROM p GROUP BY source),
r AS (SELECT *, rest - used AS left_over FROM c),
y AS (
  SELECT p.source, any_value(r.left_over) AS left_over, min({'gap': abs(r.left_over - size), 'key': key}).key AS extra
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source WHERE left_over > 0 AND key > cut AND size > 0 AND abs(left_over - size) < left_over GROUP BY p.source),
z AS (
  SELECT p.source, any_value(y.extra) AS extra FROM p JOIN y ON p.source IS NOT DISTINCT FROM y.source AND p.key = y.extra
  GROUP BY p.source HAVING abs(any_value(y.left_over) - sum(size)) < any_value(y.left_over))
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * (p.epochs + CASE WHEN p.key <= r.cut OR p.key = z.extra THEN 1 ELSE 0 END))::BIGINT AS taken, p.source
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source LEFT JOIN z ON p.source IS NOT DISTINCT FROM z.source
"""
