"""Encode-once feature job: every distinct string is encoded exactly one time."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.sets import fragments, words
from pairloom.sources.incremental import unseen

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENCODERS: dict[str, tuple[Callable[[pd.Series], pd.DataFrame], T.StructType]] = {}


def register_encoder(name: str, fn: Callable[[pd.Series], pd.DataFrame], schema: str) -> None:
    """A vectorised user encoder: a batch of strings to a frame with the schema's columns."""
    _ENCODERS[name] = (fn, T.StructType.fromDDL(schema))


def distinct_values(df: DataFrame, columns: Sequence[str], key: str = "value") -> DataFrame:
    stacked = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias(key))
    return stacked.filter(F.col(key).isNotNull()).distinct()


def encode(values: DataFrame, name: str, key: str = "value") -> DataFrame:
    """Run an encoder over the values; a failing value becomes a row with status ``error``."""
    fn, fields = _ENCODERS[name]
    names = fields.fieldNames()
    schema = T.StructType(
        [values.schema[key], T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *fields]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = batch[key]
            try:
                out = fn(s).reset_index(drop=True)[names]
                out.insert(0, "error", None)
                out.insert(0, "status", "ok")
                out.insert(0, key, s.to_numpy())
            except Exception:  # find the values at fault one by one
                rows = []
                for v in s:
                    try:
                        got = fn(pd.Series([v])).iloc[0].to_dict()
                        rows.append({key: v, "status": "ok", "error": None, **{c: got[c] for c in names}})
                    except Exception as e:
                        rows.append({key: v, "status": "error", "error": str(e), **dict.fromkeys(names)})
                out = pd.DataFrame(rows, columns=[key, "status", "error", *names])
            yield out[[key, "status", "error", *names]]

    return values.select(key).mapInPandas(run, schema)


def encode_once(
    df: DataFrame, columns: Sequence[str], encoder: Callable[[DataFrame], DataFrame], store: DataFrame | None = None, key: str = "value"
) -> DataFrame:
    """Features of all distinct strings of ``columns``: the store's rows and newly encoded ones."""
    fresh = encoder(unseen(distinct_values(df, columns, key), store, key))
    return fresh if store is None else store.unionByName(fresh)


def text_features(values: DataFrame, key: str = "value") -> DataFrame:
    """Built-in encoder for plain text (column expressions only)."""
    v = F.col(key)
    first_line = F.split(v, "\n")[0]
    return values.select(
        key,
        F.when(F.trim(v) == "", "empty").otherwise("ok").alias("status"),
        F.lower(F.trim(v)).alias("canon"),
        words(v).alias("bits"),
        F.split(v, " ")[0].alias("group_key"),
        F.size(F.split(first_line, " ")).cast("string").alias("formula"),
        fragments(v).alias("frags"),
        F.length(v).alias("n_chars"),
    )


def apply_to_pairs(df: DataFrame, name: str, fn: Callable[[pd.Series, pd.Series], pd.Series], left: str, right: str, type_: str) -> DataFrame:
    """A pure user function over both sides of a pair table, batch by batch."""
    udf = F.pandas_udf(fn, type_)
    return df.withColumn(name, udf(F.col(left), F.col(right)))


