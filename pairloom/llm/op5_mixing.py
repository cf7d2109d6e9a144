"""Mixing sources to target weights, DataFrame operations only.

Sizes are summed per source (map-side first, so a source with most of the rows costs nothing extra),
each source gets a target and a repetition rate, and a document is emitted floor(rate) times plus
once more if its hash-seeded uniform number falls under the fraction.

Targets: the shares of all sources add up to ``share`` times the total size, by weight; a target
never exceeds ``max_rate`` times its source's size, and what is cut off goes to the others by
weight until none is above. That is one common level: target = min(max_rate * size, level * weight).
The level is found by rounds over the table of sources, each an aggregate to one row.

Defined results: NULL text has size 0; a NULL source is a source of its own, last in the order;
NULL ids draw like the empty id; repeated rows with equal ids draw alike (so reruns agree); a
source without words has target 0 and is not taken; an empty table gives an empty table; columns
other than id, text and source do not matter and are kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import WORD, staged
from pairloom.operators.ordering import ordered_index
from pairloom.operators.skew import grid_join

BROADCAST_SOURCES = 100_000  # a table of sources is broadcast only if counted to be at most this long
_HEX = 13  # hash digits of the uniform draw: 52 bits, exact in a double


def words(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from the hash of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") / float(16**_HEX)


def source_rates(
    sizes: DataFrame,
    source_col: str = "source",
    size_col: str = "size",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_rate: float = 2.0,
) -> DataFrame:
    """One row per source: source, source_size, target, rate."""
    totals = staged(sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).cast("long").alias("source_size")))
    at = ordered_index(totals, [F.col("source").asc_nulls_last()], name="k")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    t = staged(at.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_rate).alias("most")))
    total, left = t.agg(F.sum("source_size"), F.sum("w")).first()
    want = share * float(total or 0)
    level, kept = (want / left if left else 0.0), -1
    while left:
        above = F.col("most") <= level * F.col("w")
        n, stopped, left = t.agg(
            F.coalesce(F.sum(above.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)),
            F.sum(F.when(~above, F.col("w"))),
        ).first()
        if n == kept:
            break
        kept = n
        if left:
            level = (want - stopped) / left
    target = F.least(F.col("most"), F.lit(float(level)) * F.col("w"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return t.select("source", "source_size", target.alias("target"), F.least(rate, F.lit(float(max_rate))).alias("rate"))


def copies(rate: Column, u: Column) -> Column:
    """floor(rate) plus one with probability equal to the fraction."""
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def with_rates(docs: DataFrame, rates: DataFrame, source_col: str, salt: Column) -> DataFrame:
    """Rows with the columns of their source; a counted broadcast, else a join that deals out hot sources."""
    r = rates.select(
        F.coalesce(F.col("source"), F.lit("")).alias("_s"),
        F.col("source").isNull().alias("_n"),
        *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "rate")],
    )
    d = docs.withColumn("_s", F.coalesce(F.col(source_col), F.lit(""))).withColumn("_n", F.col(source_col).isNull())
    if r.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return d.join(F.broadcast(r), ["_s", "_n"]).drop("_s", "_n")
    return grid_join(d, r, ["_s", "_n"], salt, F.lit(0)).drop("_s", "_n")


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    **settings,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: what the mix takes of each document.

    The texts are read once, for their sizes; everything else runs on a narrow written table.
    """
    narrow = staged(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")
        )
    )
    d = with_rates(narrow, source_rates(narrow, **settings), "source", F.xxhash64("doc_id"))
    n = copies(F.col("_rate"), draw(F.col("doc_id"), seed))
    return d.select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("size") * n).alias("taken"),
        n.alias("copies"),
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    **settings,
) -> DataFrame:
    """The mix itself: each document repeated as often as the plan says, all its columns kept."""
    sizes = staged(docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))
    d = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.struct(*_all(docs)).alias("row"))
    d = with_rates(d, source_rates(sizes, **settings), "source", F.xxhash64("id"))
    n = copies(F.col("_rate"), draw(F.col("id"), seed)).cast("int")
    return d.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), n))).select("row.*")


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]
