"""Scores, top-k per group, and report ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.ordering import attach, hash_rank, ordered_index


def pair_score(sim: Column, shared_atoms: Column, shared_bonds: Column, atom_gap: Column, bond_gap: Column) -> Column:
    """Weighted case-study score (weights are fixed values)."""
    return 0.50 * sim + 0.35 * shared_atoms + 0.15 * shared_bonds - 0.10 * atom_gap - 0.05 * bond_gap


def relaxed_score(
    sim: Column, shared_atoms: Column, shared_bonds: Column, atom_gap: Column, bond_gap: Column, ring_gap: Column
) -> Column:
    """Weighted best-case score (weights are fixed values)."""
    return (
        0.55 * sim + 0.30 * shared_atoms + 0.15 * shared_bonds - 0.12 * atom_gap - 0.06 * bond_gap - 0.03 * ring_gap
    )


def share_of_group(df: DataFrame, value: str, group: Sequence[str], name: str = "share") -> DataFrame:
    """Ratio of a value to its group's total; totals are aggregated first, so a huge group is no window."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_t"))
    out = attach(df, totals, group)
    return out.withColumn(name, F.when(F.col("_t") == 0, None).otherwise(F.col(value) / F.col("_t"))).drop("_t")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; each task keeps k rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def top_rows(df: DataFrame, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows with their rank (the k rows alone are numbered)."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def number_duplicates(df: DataFrame, key: str, order: Sequence[Column], name: str = "unique_key") -> DataFrame:
    """``key`` for the first occurrence, ``key_1``, ``key_2`` … for later ones."""
    d = ordered_index(df, list(order), [key], "_occ")
    text = F.col(key).cast("string")
    return d.withColumn(
        name, F.when(F.col("_occ") == 0, text).otherwise(F.concat(text, F.lit("_"), F.col("_occ").cast("string")))
    ).drop("_occ", "_occ_n")


def shuffled_ids(df: DataFrame, seed: int, key: Column, group: Sequence[str] = (), name: str = "id") -> DataFrame:
    """New ids 0..n-1 per group in an order fixed by seed and key."""
    return hash_rank(df, seed, key, group, name).drop(f"{name}_n")


def prefer_test(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key; test wins when the key is in both splits."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct((F.col("split") != "test").alias("_o"), *order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")
