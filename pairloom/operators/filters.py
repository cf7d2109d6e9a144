"""Row filters and classifications of the pair table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.sets import fragments


def _present(text: Column) -> Column:
    """Fragment list of a text where the word ``nan`` also means missing."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return fragments(F.when(F.lower(t) == "nan", "").otherwise(t))


def has_long_fragment(text: Column, min_length: int) -> Column:
    return F.exists(_present(text), lambda x: F.length(x) >= min_length)


def keep_comparable_pairs(df: DataFrame, max_frag_len: int = 28, max_frag_num: int = 4) -> DataFrame:
    """The four fragment rules on a compared pair table."""
    only_l, only_r = F.col("n_only_left"), F.col("n_only_right")
    return df.filter(
        (F.col("n_common") != 0)
        & ~((only_l == 0) & (only_r == 0))
        & ~has_long_fragment(F.col("only_left"), max_frag_len)
        & ~has_long_fragment(F.col("only_right"), max_frag_len)
        & (only_l <= max_frag_num)
        & (only_r <= max_frag_num)
    )


def drop_long_fragments(df: DataFrame, columns: Sequence[str], min_length: int) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | has_long_fragment(F.col(c), min_length)
    return df.filter(~bad)


def trim_fragments(text: Column, max_length: int) -> Column:
    """The same text without fragments longer than ``max_length``."""
    return F.array_join(F.filter(_present(text), lambda x: F.length(x) <= max_length), ".")


def drop_many_fragments(df: DataFrame, columns: Sequence[str], max_count: int = 4) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.size(_present(F.col(c))) > max_count)
    return df.filter(~bad)


def has_dot(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(".")), F.lit(False))


def has_several_components(text: Column) -> Column:
    """Two or more parts of length >= 3 that are not a short bracketed token."""
    def real(x: Column) -> Column:
        bracketed = x.startswith("[") & x.endswith("]") & (F.length(x) < 10)
        return (F.length(x) >= 3) & ~bracketed

    return F.size(F.filter(fragments(text), real)) > 1


def exactly_one_difference(df: DataFrame) -> DataFrame:
    return df.filter(F.col("n_diff_features") == 1)


def pair_type(n_fg: Column, n_stereo: Column, none: str = "none") -> Column:
    return (
        F.when((n_fg > 0) & (n_stereo > 0), "both")
        .when(n_fg > 0, "only_fg")
        .when(n_stereo > 0, "only_stereo")
        .otherwise(none)
    )


def pair_step(n_diff: Column, zero: str = "multi_step") -> Column:
    return F.when(n_diff == 1, "one_step").when(n_diff == 0, zero).otherwise("multi_step")


def select_kind(df: DataFrame, diff_type: str | None = None, step_num: str | None = None) -> DataFrame:
    """Rows of one type and step; the labels are derived from the counts where they are missing."""
    kind = pair_type(F.col("n_fg_diff"), F.col("n_stereo_diff"))
    step = pair_step(F.col("n_diff_features"), zero="none")
    if "diff_type" in df.columns:
        kind = F.col("diff_type")
    if "step_num" in df.columns:
        step = F.col("step_num")
    if diff_type:
        df = df.filter(kind == diff_type)
    return df.filter(step == step_num) if step_num else df


def step_of_fragments(*texts: Column) -> Column:
    counts = [F.size(fragments(t)) for t in texts]
    most = counts[0] if len(counts) == 1 else F.greatest(*counts)
    return F.when(most >= 2, "multi_step").otherwise("single_step")


def drop_unplaced(df: DataFrame) -> DataFrame:
    """Rows lacking both dataset and endpoint are dropped."""
    def filled(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    return df.filter(F.coalesce(filled("dataset_name"), filled("endpoint")).isNotNull())


def of_task_families(df: DataFrame, prefixes: Sequence[str], column: str = "Task") -> DataFrame:
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col(column).startswith(p)
    return df.filter(test)


def property_deltas(df: DataFrame, properties: Sequence[str]) -> DataFrame:
    """``delta_X`` = left - right and ``delta_abs_X``, NULL unless both sides are finite."""
    out = {}
    for p in properties:
        a, b = F.col(f"left_{p}"), F.col(f"right_{p}")

        def finite(x: Column) -> Column:
            return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

        delta = F.when(finite(a) & finite(b), a - b)
        out[f"delta_{p}"] = delta
        out[f"delta_abs_{p}"] = F.abs(delta)
    return df.withColumns(out)


def attach_properties(pairs: DataFrame, props: DataFrame, entity: str, properties: Sequence[str]) -> DataFrame:
    """Per-entity properties on both sides of a pair table."""
    for side in ("left", "right"):
        own = props.select(
            F.col(entity).alias(f"{side}_id"), *[F.col(p).alias(f"{side}_{p}") for p in properties]
        )
        pairs = pairs.join(own, f"{side}_id", "left")
    return pairs


def case_study_gate(
    df: DataFrame,
    sim: Column,
    sizes: tuple[int, int] = (4, 20),
    band: tuple[float, float] = (0.70, 0.90),
    caps: Mapping[str, float] | None = None,
) -> DataFrame:
    """One changed fragment per side within a size range, similarity inside the band, capped features."""
    lo, hi = sizes
    test = (sim >= band[0]) & (sim <= band[1])
    for side in ("left", "right"):
        test = (
            test
            & (F.col(f"only_{side}_count") == 1)
            & F.col(f"only_{side}_size").between(lo, hi)
        )
    for column, cap in (caps or {}).items():
        test = test & (F.col(column) <= cap)
    return df.filter(test)


def decode_check(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """Tags each pair with whether both codes decode back to the representation they came from.

    ``decoded``: code, repr (NULL where decoding failed), one row per distinct code.
    """
    for side in ("left", "right"):
        own = decoded.select(
            F.col("code").alias(f"{side}_code"), F.col("repr").alias(f"{side}_decoded")
        )
        df = df.join(own, f"{side}_code", "left")
        df = df.withColumn(f"{side}_decode_ok", F.col(f"{side}_decoded").isNotNull()).withColumn(
            f"{side}_matches", F.coalesce(F.col(f"{side}_decoded") == F.col(f"{side}_repr"), F.lit(False))
        )
    return df.withColumn("decode_all_ok", F.col("left_matches") & F.col("right_matches"))


def same_skeleton(df: DataFrame, left: str = "left_skeleton", right: str = "right_skeleton") -> DataFrame:
    return df.filter(F.col(left).isNotNull() & (F.col(left) == F.col(right)))
