"""Declared input schemas and the column check every operator can start with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# candidate names of the representation and the label column, first match wins (fixed values)
REPR_CANDIDATES = ("X", "SMILES", "Drug", "smiles")
LABEL_CANDIDATES = ("Y", "Label", "Target", "label")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
