"""Exact ranks, running totals and quantiles without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.session import cut, shuffle_width

_OFFSET_BITS = 33  # monotonically_increasing_id: partition number above, row offset below


def attach(df: DataFrame, extra: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``extra`` on NULL-safe ``keys`` and keep one copy of the keys."""
    renamed = extra
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def _range_sorted(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    keys = [F.col(g) for g in group] + list(order)
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # range bounds come from a sample, so the partitions are written once before anything counts them
    fixed = cut(spread.withColumn("_m", F.monotonically_increasing_id()))
    return fixed.withColumn("_part", F.shiftright("_m", _OFFSET_BITS)).withColumn(
        "_off", F.col("_m").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    )


def ordered_index(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """0-based position of each row by ``order`` (a total order), inside ``group`` if given.

    Also adds ``<name>_n``, the group size. One range shuffle; a group of any size is spread over
    as many partitions as it needs, and only (group, partition) counts are summed up.
    """
    s = _range_sorted(df, group, order)
    spans = s.groupBy(*group, "_part").agg(F.min("_off").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_part")  # at most one row per partition
    spans = spans.select(
        *group,
        "_part",
        "_lo",
        (F.sum("_c").over(w) - F.col("_c")).alias("_base"),
        F.sum("_c").over(Window.partitionBy(*group)).alias(f"{name}_n"),
    )
    if not group:
        spans = F.broadcast(spans)  # one row per partition
    out = attach(s, spans, [*group, "_part"])
    return out.withColumn(name, F.col("_base") + F.col("_off") - F.col("_lo")).drop(
        "_m", "_part", "_off", "_lo", "_base"
    )


def running_total(
    df: DataFrame, weight: str, order: Sequence[Column], group: Sequence[str] = ()
) -> DataFrame:
    """Adds ``below`` (sum of ``weight`` over earlier rows of the group) and ``total``."""
    s = _range_sorted(df, group, order)
    spans = s.groupBy(*group, "_part").agg(F.sum(weight).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_part")
    spans = spans.select(
        *group,
        "_part",
        (F.sum("_c").over(w) - F.col("_c")).alias("_base"),
        F.sum("_c").over(Window.partitionBy(*group)).alias("total"),
    )
    if not group:
        spans = F.broadcast(spans)
    inner = Window.partitionBy(*group, "_part").orderBy("_off")
    s = s.withColumn("_in", F.sum(weight).over(inner) - F.col(weight))
    out = attach(s, spans, [*group, "_part"])
    return out.withColumn("below", F.col("_base") + F.col("_in")).drop(
        "_m", "_part", "_off", "_in", "_base"
    )


def hash_rank(
    df: DataFrame,
    seed: int | str,
    key: Column,
    group: Sequence[str] = (),
    name: str = "rnd",
) -> DataFrame:
    """0-based position in the pseudo-random order md5(seed || key), plus ``<name>_n``.

    The first hex digits cut every group into even buckets, at least 4096 and at least four per shuffle
    partition, so buckets grow in number with the data. The ranking window is per bucket; bucket
    offsets are prefix sums in two levels, each over at most 4096 rows while there are under 16^6 buckets.
    """
    digits = 3
    while 16**digits < 4 * shuffle_width(df.sparkSession):
        digits += 1
    d = df.withColumn("_k", F.coalesce(key.cast("string"), F.lit(""))).withColumn(
        "_h", F.md5(F.concat(F.lit(str(seed)), F.col("_k")))
    )
    d = d.withColumn("_b", F.substring("_h", 1, digits))
    keys = ["_b"]
    if group:
        # one struct key: NULL groups match, and window and join share the same partitioning
        d, keys = d.withColumn("_g", F.struct(*group)), ["_g", "_b"]
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*keys[:-1])
    if digits > 3:
        counts = counts.withColumn("_a", F.substring("_b", 1, 3))
        coarse = counts.groupBy(*keys[:-1], "_a").agg(F.sum("_c").alias("_t"))
        coarse = coarse.select(
            *keys[:-1],
            "_a",
            (F.sum("_t").over(whole.orderBy("_a")) - F.col("_t")).alias("_before"),
            F.sum("_t").over(whole).alias(f"{name}_n"),
        )
        within = Window.partitionBy(*keys[:-1], "_a").orderBy("_b")
        counts = counts.withColumn("_base", F.sum("_c").over(within) - F.col("_c")).join(coarse, [*keys[:-1], "_a"])
        counts = counts.select(*keys, (F.col("_base") + F.col("_before")).alias("_base"), f"{name}_n")
    else:
        counts = counts.select(
            *keys,
            (F.sum("_c").over(whole.orderBy("_b")) - F.col("_c")).alias("_base"),
            F.sum("_c").over(whole).alias(f"{name}_n"),
        )
    inner = Window.partitionBy(*keys).orderBy("_h", "_k")
    d = d.withColumn("_r", F.row_number().over(inner) - 1)
    out = d.join(counts, keys)
    return out.withColumn(name, F.col("_base") + F.col("_r")).drop("_k", "_h", "_b", "_g", "_r", "_base")


def weighted_quantiles(
    counts: DataFrame,
    value: str,
    weight: str,
    probs: dict[str, float],
    group: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolation quantiles of values given with multiplicities; one row per group."""
    r = running_total(counts, weight, [F.col(value)], group)
    n = F.col("total")
    aggs = []
    for name, p in probs.items():
        pos = (n - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col(weight))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_f"))
    out = r.groupBy(*group).agg(*aggs, F.max("total").alias("n_values"))
    for name in probs:
        lo, hi, f = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        out = out.withColumn(name, lo + (hi - lo) * f).drop(f"_{name}_lo", f"_{name}_hi", f"_{name}_f")
    return out


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles of a column; equal values are counted first, so repeats cost nothing."""
    v = F.col(value).cast("double")
    counts = (
        df.filter(v.isNotNull() & ~F.isnan(v))
        .groupBy(*group, v.alias(value))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    return weighted_quantiles(counts, value, "_w", probs, group)
