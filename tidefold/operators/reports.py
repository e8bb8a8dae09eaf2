"""Corpus reports and statistics of measurements."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.text import jaccard, savings_percent, tokens
from tidefold.functions.udfs import CODECS, decompress
from tidefold.operators.scans import running
from tidefold.sources.shared import keep


def expanded_corpus(access: DataFrame, usage: DataFrame, prefixes: list[str]) -> DataFrame:
    """All access rows and the usage rows whose endpoint has one of the prefixes."""
    chosen = reduce(lambda a, b: a | b, [F.col("endpoint").startswith(p) for p in prefixes], F.lit(False))
    return access.withColumn("origin", F.lit("access")).unionByName(usage.where(chosen).withColumn("origin", F.lit("usage")))


def selected(sources: DataFrame, paths: list[str] | None = None, classes: list[str] | None = None) -> DataFrame:
    """Rows in both sets; an empty set is no filter."""
    ok = F.lit(True)
    ok = ok & F.col("path").isin(paths) if paths else ok
    return sources.where(ok & F.col("class").isin(classes) if classes else ok)


def manifest_totals(sources: DataFrame) -> DataFrame:
    """One row of (exists, bytes, lines): all, present, bytes and lines of those."""
    return sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if("exists").alias("present"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines"))


def codec_report(blobs: DataFrame, codecs: list[str]) -> DataFrame:
    """name, codec, in_bytes, out_bytes, savings, lossless of (name, content)."""
    import pandas as pd

    def work(frames):
        for pdf in frames:
            rows = []
            for name, raw in zip(pdf["name"], pdf["content"]):
                raw = b"" if raw is None else bytes(raw)
                for c in codecs:
                    out = CODECS[c](raw)
                    rows.append((name, c, len(raw), len(out), decompress(c, out) == raw))
            yield pd.DataFrame(rows, columns=["name", "codec", "in_bytes", "out_bytes", "lossless"])

    rows = blobs.select("name", "content").mapInPandas(work, "name string, codec string, in_bytes long, out_bytes long, lossless boolean")
    return rows.withColumn("savings", savings_percent(F.col("in_bytes"), F.col("out_bytes")))


def codec_totals(report: DataFrame) -> DataFrame:
    """codec, in_bytes, out_bytes, savings, passed, failed."""
    t = report.groupBy("codec").agg(F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), F.count_if("lossless").alias("passed"), F.count_if(~F.col("lossless")).alias("failed"))
    return t.withColumn("savings", savings_percent(F.col("in_bytes"), F.col("out_bytes")))


def winners(profiles: DataFrame) -> DataFrame:
    """One row of (profile, ratio, decode): best by ratio, by decoding speed and by their product."""
    return profiles.agg(F.max_by("profile", F.struct("ratio", "decode")).alias("best_ratio"), F.max_by("profile", F.struct("decode", "ratio")).alias("best_decode"), F.max_by("profile", F.struct(F.col("ratio") * F.col("decode"))).alias("best_balance"))


def best_mode(sizes: DataFrame) -> DataFrame:
    """class, mode, bytes, delta: of (class, mode, rank, bytes) the smallest, ties to the lower rank; delta to mode gzip."""
    best = sizes.groupBy("class").agg(F.min_by(F.struct("mode", "bytes"), F.struct("bytes", "rank")).alias("b"), F.max(F.when(F.col("mode") == "gzip", F.col("bytes"))).alias("gzip"))
    return best.select("class", "b.mode", "b.bytes", (F.col("b.bytes") - F.col("gzip")).alias("delta"))


def memory_matches(turns: DataFrame, bank_below: int, k: int = 3, threshold: float = 0.7) -> DataFrame:
    """conv_id, turn, rank, memory_conv, memory_turn, score: for each user turn (conv_id, turn, text) of later conversations the k most
    alike turns of earlier ones with a token likeness of at least `threshold`.

    Candidates share a token; a likeness of t bounds the sizes, and of a turn's tokens, rarest first, one of the first
    (1 - t) n + 1 must be shared, so only those are joined on.
    """
    t = turns.withColumn("tok", tokens(F.col("text"))).withColumn("id", F.struct("conv_id", "turn")).where(F.size("tok") > 0)
    rows = t.select("id", F.explode("tok").alias("w"))
    df = rows.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    order = rows.join(df, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o"))
    keep = F.floor(F.size("o") * (1 - threshold) + 1e-9).cast("int") + 1
    keys = order.select("id", F.explode(F.slice(F.col("o.w"), F.lit(1), keep)).alias("w"))
    test = keys.where(F.col("id.conv_id") >= bank_below).withColumnRenamed("id", "a")
    bank = keys.where(F.col("id.conv_id") < bank_below).withColumnRenamed("id", "b")
    pairs = test.join(bank, "w").select("a", "b").distinct()
    full = pairs.join(t.select(F.col("id").alias("a"), F.col("tok").alias("x"), "conv_id", "turn"), "a").join(t.select(F.col("id").alias("b"), F.col("tok").alias("y")), "b")
    scored = full.select("conv_id", "turn", F.col("b").alias("memory"), jaccard(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= threshold)
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("score").desc(), "memory"))
    ranked = scored.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("conv_id", "turn", "rank", F.col("memory.conv_id").alias("memory_conv"), F.col("memory.turn").alias("memory_turn"), "score")


# statistics


def order_statistics(rows: DataFrame, group: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The group, n, min, max and, by name, the value at a place (from 1) of the sorted values that is a function of n.

    Values are counted, and counts summed in order: no group is brought together in one row or, beyond
    scans.HOT_ROWS distinct values, in one task. Nulls don't count.
    """
    counts = keep(rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    upto = running(counts, group, "_v", {"_u": F.col("_c")})
    n = F.col("_n")
    totals = counts.select(*group, "_v", "_c").groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.sum("_c").alias("_n"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    at = lambda f: F.min(F.when(F.col("_u") >= f(n), F.col("_v")))
    return upto.join(totals, on).groupBy(*group, F.col("_n").alias("n")).agg(F.min("_v").alias("min"), F.max("_v").alias("max"), *[at(f).alias(name) for name, f in places.items()])


def nearest_place(p: float) -> Callable[[Column], Column]:
    """The place at p percent of the way, halves to even."""
    return lambda n: F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(p / 100.0) * (n - 1), 0).cast("long"))) + 1


def exclusive_quantiles(rows: DataFrame, group: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """pN by linear interpolation at N / 100 of n + 1, kept within 1 and n - 1; a single value is each of them."""
    position = lambda p: lambda n: F.lit(p / 100) * (n + 1)
    low = lambda p: lambda n: F.greatest(F.lit(1), F.least(n - 1, F.floor(position(p)(n))))
    high = lambda p: lambda n: F.least(n, low(p)(n) + 1)
    s = order_statistics(rows, group, value, {f"_a{p}": low(p) for p in percents} | {f"_b{p}": high(p) for p in percents})
    n = F.col("n")
    return s.select(*group, *[F.when(n < 2, F.col("min")).otherwise(F.col(f"_a{p}") + (position(p)(n) - low(p)(n)) * (F.col(f"_b{p}") - F.col(f"_a{p}"))).alias(f"p{p}") for p in percents])


def series_summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, min, p50, p95, p99, max by nearest rank."""
    s = order_statistics(rows, group, value, {f"p{p}": nearest_place(p) for p in (50, 95, 99)})
    return s.select(*group, "n", "min", "p50", "p95", "p99", "max")


def mode_rates(rows: DataFrame) -> DataFrame:
    """mode, ops, rate (operations a second), bytes, ratio (bytes before compression by bytes after) of (mode, ops,
    seconds, raw_bytes, bytes)."""
    m = rows.groupBy("mode").agg(F.sum("ops").alias("ops"), F.sum("seconds").alias("seconds"), F.sum("raw_bytes").alias("raw"), F.sum("bytes").alias("bytes"))
    return m.select("mode", "ops", F.when(F.col("seconds") > 0, F.col("ops") / F.col("seconds")).otherwise(0.0).alias("rate"), "bytes", F.when(F.col("bytes") > 0, F.col("raw") / F.col("bytes")).otherwise(1.0).alias("ratio"))


def mode_speedups(rates: DataFrame) -> DataFrame:
    """mode, other, speedup of each pair of the few modes of mode_rates(), each against each later one by name."""
    b = rates.select(F.col("mode").alias("other"), F.col("rate").alias("_r"))
    return rates.join(b, F.col("mode") < F.col("other")).select("mode", "other", F.when(F.col("_r") > 0, F.col("rate") / F.col("_r")).alias("speedup"))


def wire_summary(rows: DataFrame) -> DataFrame:
    """bench, n, errors, rate, p50, p95, p99 of calls (bench, latency in seconds, ok): calls that failed count as errors
    and have no latency."""
    totals = rows.groupBy(F.col("bench").alias("b")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.sum(F.when(F.col("ok"), F.col("latency"))).alias("seconds"))
    s = order_statistics(rows.where("ok"), ["bench"], "latency", {f"p{p}": nearest_place(p) for p in (50, 95, 99)})
    both = s.join(totals, F.col("bench") == F.col("b"))
    return both.select("bench", F.col("calls").alias("n"), "errors", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).otherwise(0.0).alias("rate"), "p50", "p95", "p99")


def status_rollup(checks: DataFrame) -> DataFrame:
    """report, n, passed, failed, status of (report, check, ok), and a row of totals with a null report. A report without
    a failed check is complete; one without any passed check is missing."""
    r = checks.rollup("report").agg(F.count("ok").alias("n"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
    return r.withColumn("status", F.when(F.col("failed") == 0, "complete").when(F.col("passed") == 0, "missing").otherwise("partial"))


def throughput(rows: DataFrame, group: list[str]) -> DataFrame:
    """ops, seconds and ops a second of (logical_ops, seconds)."""
    t = rows.groupBy(*group).agg(F.sum("logical_ops").alias("ops"), F.sum("seconds").alias("seconds"))
    return t.withColumn("rate", F.when(F.col("seconds") > 0, F.col("ops") / F.col("seconds")).otherwise(0.0))


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def deltas(now: DataFrame, base: DataFrame, name: str, value: str, higher_is_better: bool = True) -> DataFrame:
    """name, delta, percent, verdict against a baseline; n/a where that is 0 or missing."""
    j = now.join(base.select(name, F.col(value).alias("_b")), name, "left")
    d = F.col(value) - F.col("_b")
    na = F.col("_b").isNull() | (F.col("_b") == 0)
    better = d > 0 if higher_is_better else d < 0
    return j.select(name, d.alias("delta"), F.when(~na, F.round(d / F.col("_b") * 100, 3)).alias("percent"), F.when(na, "n/a").when(d == 0, "same").when(better, "improved").otherwise("regressed").alias("verdict"))


def competitor_summary(rows: DataFrame, ours: str, theirs: str) -> DataFrame:
    """operation, speedup, latency_gain, winner of (system, operation, rate, latency)."""
    p = rows.groupBy("operation").pivot("system", [ours, theirs]).agg(F.avg("rate").alias("rate"), F.avg("latency").alias("latency"))
    c = lambda s, m: F.col(f"`{s}_{m}`")
    speed = c(ours, "rate") / F.nullif(c(theirs, "rate"), F.lit(0.0))
    gain = (1 - c(ours, "latency") / F.nullif(c(theirs, "latency"), F.lit(0.0))) * 100
    return p.select("operation", F.round(speed, 6).alias("speedup"), F.round(gain, 6).alias("latency_gain"), F.when(speed >= 1, ours).otherwise(theirs).alias("winner"))


def qualified(rows: DataFrame, speedup: float, top1: float, recall: float) -> DataFrame:
    return rows.where((F.col("speedup_vs_exact") >= speedup) & (F.col("top1_match_rate") >= top1) & (F.col("recall_at_k") >= recall))
