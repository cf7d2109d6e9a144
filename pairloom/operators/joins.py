"""Lookup, attach, alignment and anti joins around the pair and prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.functions.sets import tanimoto
from pairloom.operators.skew import grid_join
from pairloom.session import cut, together


def _sides_of_keys(
    entities: DataFrame, by: Sequence[str], key: str, repr_col: str, compat: bool
) -> tuple[DataFrame, DataFrame]:
    """by, key, left_repr and by, key, right_repr: distinct strings of each class, written once."""
    d = entities.filter(F.col(key).isNotNull() & (F.col(key) != "") & F.col("label").isin(0, 1))
    # classes of a string are looked up among all its rows, keyed or not
    seen = (
        entities.filter(F.col("label").isin(0, 1))
        .groupBy(*by, repr_col)
        .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    )
    one = d.groupBy(*by, repr_col, key).agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
    both = seen.filter("_lo < _hi").select(*by, repr_col)
    pure = one.join(both, [*by, repr_col], "left_anti")
    pos = pure.filter("_b = 1").select(*by, key, F.col(repr_col).alias("left_repr"))
    neg_src = pure.filter("_a = 0")
    if compat:
        neg_src = neg_src.unionByName(one.join(both, [*by, repr_col], "left_semi"))
    neg = neg_src.select(*by, key, F.col(repr_col).alias("right_repr"))
    return tuple(together(lambda: cut(pos), lambda: cut(neg)))


def pairs_sharing_key(
    entities: DataFrame, by: Sequence[str], key: str, repr_col: str = "repr", compat: bool = False
) -> DataFrame:
    """Positive x negative strings of a block with the same non-empty key.

    Strings found in both classes are dropped from both. ``compat=True`` gives the sequential
    subtraction instead, where such a string stays on the negative side. For counts, or where the pairs are
    needed later, :func:`classes_sharing_key` says the same without listing them.
    """
    pos, neg = _sides_of_keys(entities, by, key, repr_col, compat)
    return grid_join(pos, neg, [*by, key], F.col("left_repr"), F.col("right_repr"))


def classes_sharing_key(
    entities: DataFrame, by: Sequence[str], key: str, repr_col: str = "repr", compat: bool = False
) -> DataFrame:
    """The same pairs factorised, one row per key: by, key, n_left, n_right, n_pairs. Counts only are moved."""
    pos, neg = _sides_of_keys(entities, by, key, repr_col, compat)
    one = F.count(F.lit(1))
    out = pos.groupBy(*by, key).agg(one.alias("n_left")).join(neg.groupBy(*by, key).agg(one.alias("n_right")), [*by, key])
    return out.withColumn("n_pairs", F.col("n_left") * F.col("n_right"))


def last_wins(mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key, the one with the largest ``order``."""
    return (
        mapping.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(value, order).alias(value))
    )


def two_key_lookup(
    df: DataFrame, raw: str, canonical: str, mapping: DataFrame, map_raw: str, map_canonical: str, value: str, order: str
) -> DataFrame:
    """Value by raw string, else by canonical string, else ''."""
    by_raw = last_wins(mapping, map_raw, value, order).select(
        F.col(map_raw).alias(raw), F.col(value).alias("_v1")
    )
    by_canon = last_wins(mapping, map_canonical, value, order).select(
        F.col(map_canonical).alias(canonical), F.col(value).alias("_v2")
    )
    out = df.join(by_raw, raw, "left").join(by_canon, canonical, "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2", F.lit(""))).drop("_v1", "_v2")


def attach_both_sides(
    pairs: DataFrame, meta: DataFrame, entity: str, columns: Sequence[str], left: str, right: str
) -> DataFrame:
    """Entity columns on both sides as ``left_<c>`` and ``right_<c>``; unknown entities give NULL."""
    for side, key in (("left", left), ("right", right)):
        own = meta.select(F.col(entity).alias(key), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(own, key, "left")
    return pairs


def attach_features(df: DataFrame, features: DataFrame, key: str, empty: Mapping[str, Column]) -> DataFrame:
    """Feature columns by key; a missing row gives the stated empty value."""
    out = df.join(features, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), e) for c, e in empty.items()})


def full_merge(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join; columns of both tables are taken from the left one first."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    right = b
    for c in shared:
        right = right.withColumnRenamed(c, f"_b_{c}")
    out = a.join(right, list(keys), "full_outer")
    for c in shared:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_b_{c}"))).drop(f"_b_{c}")
    return out


def move_flagged(source: DataFrame, target: DataFrame, flags: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``source`` whose keys are flagged go to ``target``."""
    moved = source.join(flags.select(*keys), list(keys), "left_semi")
    kept = source.join(flags.select(*keys), list(keys), "left_anti")
    return kept, target.unionByName(moved, allowMissingColumns=True)


def only_in_first(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def align(frames: Sequence[tuple[str, DataFrame]], key: str, meta: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Inner join of several prediction tables on id.

    Metadata comes from the first one; ``meta_mismatch`` is 1 where any table disagrees (NULL-safe).
    Metrics get their table's name as prefix.
    """
    first_name, first = frames[0]
    out = first.select(key, *meta, *[F.col(m).alias(f"{first_name}_{m}") for m in metrics if m in first.columns])
    same = F.lit(True)
    drop = []
    for name, df in frames[1:]:
        out = out.join(
            df.select(
                key,
                *[F.col(c).alias(f"_{name}_{c}") for c in meta],
                *[F.col(m).alias(f"{name}_{m}") for m in metrics if m in df.columns],
            ),
            key,
        )
        for c in meta:
            same = same & F.col(c).eqNullSafe(F.col(f"_{name}_{c}"))
            drop.append(f"_{name}_{c}")
    return out.withColumn("meta_mismatch", (~same).cast("int")).drop(*drop)


def attach_gold(preds: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """Gold answer by id; the one stored with the prediction where the table has none."""
    g = gold.select(key, F.col("gold").alias("_g"))
    return preds.join(g, key, "left").withColumn("gold", F.coalesce("_g", "gold")).drop("_g")


def attach_source_row(preds: DataFrame, rows: DataFrame, columns: Sequence[str], index: str = "source_index") -> DataFrame:
    """Source columns by explicit position; an index outside the table gives NULL."""
    return preds.join(rows.select(index, *columns), index, "left")


def chained_inputs(
    stage1: DataFrame, stage2: DataFrame, key: str, anchors: DataFrame | None = None
) -> DataFrame:
    """Stage-2 input from the stage-1 prediction, stage-3 input from both; blank predictions give gold.

    Restricted to ids present in both stages and, if given, among the anchors.
    """
    def filled(pred: str, gold: str) -> Column:
        return F.coalesce(F.nullif(F.trim(pred), F.lit("")), F.col(gold))

    a = stage1.select(key, filled("pred", "gold").alias("stage2_input"))
    b = stage2.select(key, filled("pred", "gold").alias("_second"))
    out = a.join(b, key)
    if anchors is not None:
        out = out.join(anchors.select(key), key, "left_semi")
    return out.withColumn("stage3_input", F.concat_ws(" || ", "stage2_input", "_second")).drop("_second")


def few_shot_examples(
    ranked: DataFrame, test: DataFrame, train: DataFrame, answer: Sequence[str], show: Sequence[str], k: int
) -> DataFrame:
    """Up to k examples per test row from its ranked train rows.

    Train rows with the test row's own answer tuple are left out, equal tuples are used once (best
    rank), and the rest is renumbered. ``ranked``: q_id, rank, p_id. Gives q_id, examples
    array<struct<n, p_id, show…>>. The list holds at most k entries.
    """
    t = test.select(F.col("q_id"), *[F.coalesce(c, F.lit("")).alias(f"_q_{c}") for c in answer])
    cols = dict.fromkeys([*answer, *show])
    p = train.select("p_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    d = ranked.select("q_id", "rank", "p_id").join(p, "p_id").join(t, "q_id")
    leak = F.lit(True)
    for c in answer:
        leak = leak & (F.col(c) == F.col(f"_q_{c}"))
    d = d.filter(~leak)
    # the ranked list is short (its own k per test row), so both windows are small by construction
    once = Window.partitionBy("q_id", *answer).orderBy("rank")
    d = d.withColumn("_first", F.row_number().over(once)).filter("_first = 1")
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).filter(F.col("n") <= k)
    return d.groupBy("q_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "p_id", *show))).alias("examples")
    )


def similar_to_row(
    df: DataFrame, index: str, ref, left_bits: str, right_bits: str, left_size: str, right_size: str, max_delta: int, k: int
) -> DataFrame:
    """Top-k rows by the mean of both sides' set similarity to one reference row, sizes within a gap."""
    one = (
        df.filter(F.col(index) == ref)
        .select(
            F.col(left_bits).alias("_l"), F.col(right_bits).alias("_r"), F.col(left_size).alias("_ls"), F.col(right_size).alias("_rs")
        )
        .limit(1)
    )
    d = df.filter(F.col(index) != ref).crossJoin(F.broadcast(one))  # one row
    d = d.filter(
        (F.abs(F.col(left_size) - F.col("_ls")) <= max_delta) & (F.abs(F.col(right_size) - F.col("_rs")) <= max_delta)
    )
    d = d.select(
        index, tanimoto(F.col(left_bits), F.col("_l")).alias("sim_left"), tanimoto(F.col(right_bits), F.col("_r")).alias("sim_right")
    )
    return (
        d.withColumn("score", (F.col("sim_left") + F.col("sim_right")) / 2)
        .orderBy(F.desc("score"), index)
        .limit(k)
    )
