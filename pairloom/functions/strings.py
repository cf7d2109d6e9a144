"""String metrics and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / max(length, 1)."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1.0 - F.levenshtein(a, b) / longest


def code_tokens(code: Column) -> Column:
    """Parts of a code string after removing blanks; empty parts dropped, duplicates kept."""
    flat = F.replace(F.trim(text_or_empty(code)), F.lit(" "), F.lit(""))
    return F.filter(F.split(flat, "[.]"), lambda x: x != "")


def same_multiset(gold: Column, pred: Column) -> Column:
    """1.0 if the parts agree as a multiset and gold is not empty, else 0.0."""
    same = F.sort_array(code_tokens(gold)) == F.sort_array(code_tokens(pred))
    return F.when((F.trim(text_or_empty(gold)) != "") & same, 1.0).otherwise(0.0)


def set_precision_recall_f1(gold: Column, pred: Column) -> dict[str, Column]:
    """Set precision, recall and F1 of the parts, with the evaluation's edge cases."""
    g, p = F.array_distinct(code_tokens(gold)), F.array_distinct(code_tokens(pred))
    ng, np_ = F.size(g), F.size(p)
    tp = F.size(F.array_intersect(g, p))
    precision = (
        F.when((ng == 0) & (np_ == 0), 1.0).when((ng == 0) | (np_ == 0), 0.0).otherwise(tp / np_)
    )
    recall = F.when(ng == 0, 1.0).when(np_ == 0, 0.0).otherwise(tp / ng)
    f1 = (
        F.when((ng == 0) & (np_ == 0), 1.0)
        .when((ng == 0) | (np_ == 0) | (tp == 0), 0.0)
        .otherwise(2.0 * tp / (ng + np_))
    )
    return {"precision": precision, "recall": recall, "f1": f1}


def char_precision(gold: Column, pred: Column, n: int = 1) -> Column:
    """Share of the prediction's character n-grams that gold also has, counted with multiplicity.

    For n = 1 the text is never split: for each distinct character of the prediction the number of
    occurrences is a length difference.
    """
    g = F.replace(F.trim(text_or_empty(gold)), F.lit(" "), F.lit(""))
    p = F.replace(F.trim(text_or_empty(pred)), F.lit(" "), F.lit(""))
    if n == 1:
        total = F.length(p)

        def times(s: Column, x: Column) -> Column:
            return F.length(s) - F.length(F.replace(s, x, F.lit("")))

        kinds = F.array_distinct(F.split(p, ""))
        hits = F.aggregate(
            F.filter(kinds, lambda x: x != ""),
            F.lit(0),
            lambda acc, x: acc + F.least(times(p, x), times(g, x)),
        )
    else:
        total = F.greatest(F.length(p) - n + 1, F.lit(0))

        def grams(s: Column) -> Column:
            return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

        gg, pg = grams(g), grams(p)

        def occurrences(arr: Column, x: Column) -> Column:
            return F.size(F.filter(arr, lambda y: y == x))

        hits = F.aggregate(
            F.array_distinct(pg),
            F.lit(0),
            lambda acc, x: acc + F.least(occurrences(pg, x), occurrences(gg, x)),
        )
    empty = (F.length(g) < n) | (total == 0)
    return F.when(empty, 0.0).otherwise(hits / total)


def joined_parts(*parts: Column) -> Column:
    """Non-empty trimmed parts joined with a dot."""
    cleaned = F.array(*[F.trim(text_or_empty(p)) for p in parts])
    return F.array_join(F.filter(cleaned, lambda x: x != ""), ".")


def exact_match(gold: Column, pred: Column) -> Column:
    return (F.trim(text_or_empty(gold)) == F.trim(text_or_empty(pred))).cast("int")


def display_number(x: Column) -> Column:
    """Six significant digits without trailing zeros; NULL and NaN are shown as an empty string."""
    v = x.cast("double")
    s = F.format_string("%.6g", v)
    short = F.when(s.contains("."), F.regexp_replace(s, r"\.?0+(e|$)", "$1")).otherwise(s)
    return F.when(v.isNull() | F.isnan(v), "").otherwise(short)


def plain_placeholders(pattern: Column) -> Column:
    """Numbered attachment points ``[*:n]`` become ``*``."""
    return F.regexp_replace(pattern, r"\[\*:\d+\]", "*")
