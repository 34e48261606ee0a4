"""Keys, labels and counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scene_bucket(scene: Column, buckets: int = 100) -> Column:
    """Trailing digits modulo buckets; without any, the first 4 bytes of the SHA-256 modulo buckets."""
    digits = F.regexp_extract(scene, r"(\d+)$", 1)
    by_hash = F.conv(F.substring(F.sha2(scene, 256), 1, 8), 16, 10).cast("long") % buckets
    return F.when(digits != "", digits.cast("decimal(38,0)") % buckets).otherwise(by_hash).cast("int")


def numeric_first(key: Column) -> list[Column]:
    """Sort expressions: whole numbers by value before everything else by text."""
    number = key.try_cast("bigint")
    return [number.isNull(), number, key]


def compact_count(v: Column) -> Column:
    """1234 as 1.2K, with K, M and B, halves to even."""
    scaled = lambda d, unit: F.concat(F.bround(v / d, 1).cast("string"), F.lit(unit))
    return F.when(v >= 10**9, scaled(10**9, "B")).when(v >= 10**6, scaled(10**6, "M")).when(v >= 10**3, scaled(10**3, "K")).otherwise(v.cast("string"))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")


def join_phrases(phrases: Column) -> Column:
    """'a', 'a and b', 'a, b, and c'."""
    n = F.size(phrases)
    return F.when(n == 1, phrases[0]).when(n == 2, F.array_join(phrases, " and ")).when(n > 2, F.concat(F.array_join(F.slice(phrases, 1, n - 1), ", "), F.lit(", and "), F.element_at(phrases, -1)))


def count_key(*parts: Column) -> Column:
    """The parts of a counter's key joined by tabs."""
    return F.concat_ws("\t", *[p.cast("string") for p in parts])


def code_points(s: Column, most: int | None = None) -> Column:
    """Array of the code points of a string, of at most so many characters."""
    points = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    return points if most is None else F.slice(points, 1, most)
