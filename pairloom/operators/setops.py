"""Unions, de-duplication, source merging and row-level set algebra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.sets import fragments


def union_common(*frames: DataFrame) -> DataFrame:
    """Rows of all frames on the columns every frame has (sorted by name)."""
    shared = sorted(set.intersection(*[set(f.columns) for f in frames]))
    return reduce(lambda a, b: a.unionByName(b), [f.select(*shared) for f in frames])


def union_all_columns(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def entities_of(pairs: DataFrame, left: str = "left_repr", right: str = "right_repr") -> DataFrame:
    """Distinct non-blank entities of both sides, trimmed."""
    both = pairs.select(F.explode(F.array(F.trim(left), F.trim(right))).alias("entity"))
    return both.filter(F.col("entity").isNotNull() & (F.col("entity") != "")).distinct()


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``; an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def conflicted_entities(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Entities that occur on both sides of the pair table."""
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col(left).alias("entity"), F.lit(1).alias("side")),
                F.struct(F.col(right).alias("entity"), F.lit(0).alias("side")),
            )
        ).alias("s")
    ).select("s.*")
    return (
        sides.filter(F.col("entity").isNotNull() & (F.col("entity") != ""))
        .groupBy("entity")
        .agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .filter("lo < hi")
        .select("entity")
    )


def merge_sources(
    sources: DataFrame, order: Sequence[str], left: str, right: str, dataset: str, endpoint: str
) -> DataFrame:
    """One clean table from several: conflicted or empty sides dropped, first row per pair kept."""
    bad = conflicted_entities(sources, left, right)
    d = sources.filter(
        F.col(left).isNotNull() & (F.col(left) != "") & F.col(right).isNotNull() & (F.col(right) != "")
    )
    for side in (left, right):
        d = d.join(bad.withColumnRenamed("entity", side), side, "left_anti")
    return (
        first_rows(d, [left, right], order)
        .withColumn("dataset_name", F.lit(dataset))
        .withColumn("endpoint", F.lit(endpoint))
    )


def compare_fragments(df: DataFrame, left: str, right: str) -> DataFrame:
    """Fragment sets of both codes, their common and one-sided parts, counts and a JSON of uniques."""
    a, b = F.array_distinct(fragments(F.col(left))), F.array_distinct(fragments(F.col(right)))
    d = df.withColumn("_a", a).withColumn("_b", b)
    d = d.withColumns(
        {
            "_c": F.sort_array(F.array_intersect("_a", "_b")),
            "_l": F.sort_array(F.array_except("_a", "_b")),
            "_r": F.sort_array(F.array_except("_b", "_a")),
        }
    )

    def uniques(column: str, side: str) -> Column:
        return F.transform(column, lambda x: F.struct(x.alias("fragment"), F.lit(side).alias("side")))

    return d.withColumns(
        {
            "left_fragments": F.array_join(F.sort_array("_a"), "."),
            "right_fragments": F.array_join(F.sort_array("_b"), "."),
            "common": F.array_join("_c", "."),
            "only_left": F.array_join("_l", "."),
            "only_right": F.array_join("_r", "."),
            "n_common": F.size("_c"),
            "n_only_left": F.size("_l"),
            "n_only_right": F.size("_r"),
            "has_diff": (F.size("_l") > 0) | (F.size("_r") > 0),
            "unique_json": F.to_json(F.concat(uniques("_l", "left"), uniques("_r", "right"))),
        }
    ).drop("_a", "_b", "_c", "_l", "_r")


def common_ids(frames: Sequence[DataFrame], key: str, anchors: DataFrame | None = None) -> DataFrame:
    """Ids present in every frame (and among the anchors)."""
    ids = frames[0].select(key).distinct()
    for f in [*frames[1:], *([anchors] if anchors is not None else [])]:
        ids = ids.join(f.select(key), key, "left_semi")
    return ids
