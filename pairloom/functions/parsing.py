"""Answers and lenient JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_field(text: Column, key: str) -> Column:
    """A string field of a JSON object, trimmed; '' when the text is no object or lacks the key."""
    return F.trim(F.coalesce(F.get_json_object(text, f"$.{key}"), F.lit("")))


def is_json(text: Column) -> Column:
    """One whole JSON value. The parser stops after the first value, so the text is read as the only
    element of a list: anything behind that value then breaks the list or becomes a second element."""
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first, second = (F.try_variant_get(parsed, f"$[{i}]", "variant") for i in (0, 1))
    return F.coalesce(first.isNotNull() & second.isNull(), F.lit(False))


def is_json_object(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.startswith("{") & is_json(t)


def json_object_in(text: Column) -> Column:
    """The JSON object of a model reply: the whole text, else from its first ``{`` to its last ``}``."""
    t = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(is_json(t), t).when(is_json(inner), inner)


def answer_of(pred: Column) -> Column:
    """The answer string of a stored prediction.

    Plain text is the answer; a JSON object gives its ``answer``; an ``answer`` that is itself a JSON
    object is merged over the outer one, so its own ``answer`` wins when there is one.
    """
    t = F.trim(F.coalesce(pred, F.lit("")))
    outer = F.trim(F.coalesce(F.get_json_object(t, "$.answer"), F.lit("")))
    inner = F.coalesce(F.get_json_object(outer, "$.answer"), outer)
    return F.when(is_json_object(t), F.when(is_json_object(outer), F.trim(inner)).otherwise(outer)).otherwise(t)


def normalise_literal(text: Column) -> Column:
    """Python-literal text of a list or dict as JSON: tuples to lists, single to double quotes."""
    t = F.translate(F.trim(F.coalesce(text, F.lit(""))), "()", "[]")
    t = F.regexp_replace(F.regexp_replace(t, r",\s*\]", "]"), "'", '"')
    return F.when(F.lower(t).isin("", "nan", "none"), F.lit(None)).otherwise(t)


def literal_as(text: Column, schema: str) -> Column:
    """Parsed literal; anything unreadable becomes NULL."""
    return F.from_json(normalise_literal(text), schema)
