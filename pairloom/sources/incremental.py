"""Re-runs that only touch what is not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame | None, key: str = "id", reset: bool = False) -> DataFrame:
    """Inputs without an earlier good answer (a row that is no error and has a prediction)."""
    if done is None or reset:
        return inputs
    good = done.filter(
        ~F.coalesce(F.col("is_error"), F.lit(False)) & (F.trim(F.coalesce("pred", F.lit(""))) != "")
    )
    return inputs.join(good.select(key), key, "left_anti")


def unseen(values: DataFrame, store: DataFrame | None, key: str) -> DataFrame:
    """Distinct keys that the feature store does not hold."""
    keys = values.select(key).filter(F.col(key).isNotNull()).distinct()
    return keys if store is None else keys.join(store.select(key), key, "left_anti")
