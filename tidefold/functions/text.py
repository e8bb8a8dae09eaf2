"""Token, key and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_PATTERN = r"^[A-Za-z0-9_\-:.]+$"


def tokens(text: Column) -> Column:
    """Distinct lower-cased [a-z0-9_]+ tokens and all their character trigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    own = F.transform(words, lambda t: F.when(F.length(t) >= 3, F.concat(F.array(t), grams(t))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(own))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of tokens; 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def slugify(text: Column, default: str = "slice") -> Column:
    slug = F.expr("NULL") if text is None else F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", default).otherwise(slug)


def savings_percent(before: Column, after: Column) -> Column:
    return F.round((1 - after / F.greatest(before, F.lit(1))) * 100, 3)


def ratio(before: Column, after: Column) -> Column:
    """1 where nothing was written."""
    return F.when(after > 0, before / after).otherwise(1.0)


def fixed_window(epoch: Column, width: int) -> Column:
    return (F.floor(epoch / width) * width).cast("long")


def valid_key(key: Column, longest: int = 1024) -> Column:
    return (F.length(key) > 0) & (F.length(key) <= longest) & key.rlike(KEY_PATTERN)


def sanitise(metadata: Column, key_length: int = 40, value_length: int = 400) -> Column:
    """A map without null values, keys and values cut to length."""
    kept = F.map_filter(metadata, lambda k, v: v.isNotNull())
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(F.substring(e["key"], 1, key_length), F.substring(e["value"], 1, value_length)))
    return F.map_from_entries(entries)


def epoch_micros(ts: Column) -> Column:
    """Of a timestamp without zone, as if in UTC, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def epoch_seconds(ts: Column) -> Column:
    return epoch_micros(ts) / 1000000.0
