"""Set arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Distinct lower-case words: the built-in text stand-in for fingerprint bits."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def fragments(code: Column, sep: str = "[.]") -> Column:
    """Non-empty, trimmed parts of a ``.``-joined string, duplicates kept; NULL gives an empty list."""
    parts = F.transform(F.split(F.coalesce(code, F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def tanimoto_counts(common: Column, a: Column, b: Column) -> Column:
    """|A∩B| / |A∪B| from sizes; two empty sets give 0."""
    union = a + b - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common / union)


def tanimoto(a: Column, b: Column) -> Column:
    """Set similarity of two distinct-element arrays."""
    common = F.size(F.array_intersect(a, b))
    return tanimoto_counts(common, F.size(a), F.size(b))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * common / total)


def shingles(text: Column, n: int) -> Column:
    """Distinct character n-grams, in one pass over the text; a shorter text is its own only element."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array(text))
