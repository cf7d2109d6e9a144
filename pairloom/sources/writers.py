"""Partitioned and record sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def path_name(name: Column) -> Column:
    """Directory-safe name: hostile characters and runs of ``_`` become one ``_``; empty is ``unknown``."""
    hostile = r'[/\\:;|?*<>"\n\t]'
    s = F.regexp_replace(F.trim(F.coalesce(name.cast("string"), F.lit(""))), hostile, "_")
    s = F.regexp_replace(F.regexp_replace(s, "_{2,}", "_"), r"^[._ ]+|[._ ]+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def write_by_endpoint(df: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    """One folder per dataset and endpoint (and ``extra`` columns), names made path-safe.

    Written from the partitions as they are: no shuffle, so one huge endpoint is written by many tasks.
    """
    safe = df.withColumn("dataset", path_name(F.col("dataset_name"))).withColumn(
        "endpoint_dir", path_name(F.col("endpoint"))
    )
    safe.write.mode("overwrite").partitionBy("dataset", "endpoint_dir", *extra).parquet(path)


def read_split_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Train rows come from ``train_test`` only, test rows from there and from unseen endpoints."""
    df = spark.read.parquet(path)
    return merge_splits(df)


def merge_splits(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    seen = F.col("split_type") == "train_test"
    train = df.filter(seen & (F.col("split") == "train"))
    test = df.filter((seen & (F.col("split") == "test")) | (F.col("split_type") == "unseen_endpoint_test"))
    return train, test


def write_records(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """JSON lines, one folder per value of ``by``."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.json(path)
