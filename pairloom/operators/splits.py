"""Train / valid / test assignment. Every operator adds a ``split`` column.

Orders come from :mod:`ordering`, so no group, endpoint or table is ever ranked in one task. Greedy
fills work on the table of group sizes; equal sizes are handled together, and a table of n rows has
fewer than sqrt(2 n) + 1 different group sizes, which bounds what one fill sees.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.operators.joins import move_flagged
from pairloom.operators.ordering import attach, hash_rank, ordered_index, running_total
from pairloom.operators.skew import lookup, row_hash
from pairloom.session import cut, stored

# task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cut_by_index(index: Column, n: Column, train: float, valid: float) -> Column:
    """Split of a 0-based position; cut points are truncated."""
    first = F.floor(F.lit(train) * n)
    second = F.floor(F.lit(train + valid) * n)
    return F.when(index < first, "train").when(index < second, "valid").otherwise("test")


def random_split(df: DataFrame, key: str, train: float = 0.8, valid: float = 0.1, seed: int = 0) -> DataFrame:
    d = hash_rank(df, seed, F.col(key), (), "_i")
    return d.withColumn("split", cut_by_index(F.col("_i"), F.col("_i_n"), train, valid)).drop("_i", "_i_n")


def random_group_split(df: DataFrame, group: str, train: float = 0.8, valid: float = 0.1, seed: int = 0) -> DataFrame:
    """Whole groups; the cut is on the number of groups."""
    groups = cut(random_split(df.select(group).distinct(), group, train, valid, seed))
    return lookup(df, groups, [group], row_hash(df), "inner", null_safe=True)


def stratified_split(
    df: DataFrame, key: str, strata: Sequence[str], train: float = 0.8, valid: float = 0.1, seed: int = 0
) -> DataFrame:
    """Each stratum (label or label vector) is cut at round-half-even shares of its size."""
    d = hash_rank(df, seed, F.col(key), strata, "_i")
    n, i = F.col("_i_n"), F.col("_i")
    first = F.bround(F.lit(train) * n)
    second = first + F.bround(F.lit(valid) * n)
    split = F.when(i < first, "train").when(i < second, "valid").otherwise("test")
    return d.withColumn("split", split).drop("_i", "_i_n")


def ordered_label_split(
    df: DataFrame, key: str, label: str, train: float = 0.8, valid: float = 0.1, seed: int = 0, tail: str = "drop"
) -> DataFrame:
    """Rows sorted by label in blocks of ten, shuffled within a block and cut.

    The last block with fewer than ten rows is dropped, or goes to train with ``tail='train'``.
    """
    d = ordered_index(df, [F.col(label), F.col(key)], (), "_i")
    full = F.floor(F.col("_i_n") / 10) * 10
    d = d.withColumn("_full", F.col("_i") < full).withColumn("_block", F.floor(F.col("_i") / 10))
    order = [F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1)
    a, b = round(train * 10), round(train * 10) + round(valid * 10)
    split = F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "valid").otherwise("test")
    d = d.withColumn("split", F.when(F.col("_full"), split).otherwise("train"))
    if tail == "drop":
        d = d.filter("_full")
    return d.drop("_i", "_i_n", "_full", "_block", "_r")


def k_fold_by_label(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Contiguous folds of the label order; the first n mod k folds get one row more."""
    d = ordered_index(df, [F.col(label), F.col(key)], (), "_i")
    i, n = F.col("_i"), F.col("_i_n")
    q, r = F.floor(n / k), n % k
    head = r * (q + 1)
    fold = F.when(i < head, F.floor(i / (q + 1))).otherwise(r + F.floor((i - head) / F.greatest(q, F.lit(1))))
    return d.withColumn("fold", fold.cast("int")).drop("_i", "_i_n")


def k_fold_random(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Folds split off one after another, each int(rest / folds left) rows of the random order."""
    d = hash_rank(df, seed, F.col(key), (), "_i")
    fold, start, rest = F.lit(k - 1), F.lit(0).cast("long"), F.col("_i_n")
    bounds = []
    for f in range(k - 1):
        size = F.floor(rest / (k - f))
        bounds.append((f, start + size))
        start, rest = start + size, rest - size
    for f, upper in reversed(bounds):
        fold = F.when(F.col("_i") < upper, f).otherwise(fold)
    return d.withColumn("fold", fold.cast("int")).drop("_i", "_i_n")


def order_split(df: DataFrame, order: Sequence[str], train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Cut of the order by the given columns (index, property or time); the last one is the key."""
    d = ordered_index(df, [F.col(c) for c in order], (), "_i")
    return d.withColumn("split", cut_by_index(F.col("_i"), F.col("_i_n"), train, valid)).drop("_i", "_i_n")


def specified_split(df: DataFrame, key: str, valid_ids: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Listed ids go to valid or test (test wins), the rest to train."""
    listed = (
        valid_ids.select(F.col(key), F.lit(1).alias("_s"))
        .unionByName(test_ids.select(F.col(key), F.lit(2).alias("_s")))
        .groupBy(key)
        .agg(F.max("_s").alias("_s"))
    )
    d = df.join(listed, key, "left")
    return d.withColumn(
        "split", F.when(F.col("_s") == 2, "test").when(F.col("_s") == 1, "valid").otherwise("train")
    ).drop("_s")


def time_split(df: DataFrame, years: DataFrame, key: str, year: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Order by (year, id) after joining the year table."""
    return order_split(df.join(years.select(key, year), key), [year, key], train, valid)


# --- greedy fills ---------------------------------------------------------------------------------


def _group_table(df: DataFrame, by: Sequence[str], group: str, key: str) -> DataFrame:
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(*by, group)
        .agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first"))
    )


def _how_many_fit(used: int, size: int, count: int, limit: float) -> int:
    """Largest m <= count with used + m * size <= limit."""
    m = max(0, min(count, int((limit - used) // size)))
    while m < count and used + (m + 1) * size <= limit:
        m += 1
    while m > 0 and used + m * size > limit:
        m -= 1
    return m


def fill_by_size(
    groups: DataFrame, totals: DataFrame, by: Sequence[str], order: Sequence[Column], train: float, valid: float
) -> DataFrame:
    """Largest groups first into train, then valid, then test, as long as they fit.

    ``groups``: by, size and the columns of ``order`` (total order among groups of one size);
    ``totals``: by, n. Adds ``split`` to each group.
    """
    g = cut(groups)
    blocks = list(by)
    if not blocks:
        g, totals, blocks = g.withColumn("_all", F.lit(0)), totals.withColumn("_all", F.lit(0)), ["_all"]
    sizes = g.groupBy(*blocks, "size").agg(F.count(F.lit(1)).alias("n_groups"))
    sizes = attach(sizes, totals, blocks)
    schema = T.StructType(
        [sizes.schema[c] for c in blocks]
        + [T.StructField(c, T.LongType()) for c in ("size", "take_train", "take_valid")]
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False).reset_index(drop=True)
        n = int(pdf["n"].iloc[0])
        train_limit, valid_limit = train * n, (train + valid) * n
        in_train = in_valid = 0
        takes = []
        for size, count in zip(pdf["size"].tolist(), pdf["n_groups"].tolist()):
            a = _how_many_fit(in_train, size, count, train_limit)
            in_train += a * size
            b = _how_many_fit(in_train + in_valid, size, count - a, valid_limit)
            in_valid += b * size
            takes.append((a, b))
        out = pdf[[*blocks, "size"]].copy()
        out["take_train"] = [a for a, _ in takes]
        out["take_valid"] = [b for _, b in takes]
        return out

    takes = sizes.groupBy(*blocks).applyInPandas(fill, schema)
    ranked = ordered_index(g, list(order), [*blocks, "size"], "_r")
    out = attach(ranked, takes, [*blocks, "size"])
    split = (
        F.when(F.col("_r") < F.col("take_train"), "train")
        .when(F.col("_r") < F.col("take_train") + F.col("take_valid"), "valid")
        .otherwise("test")
    )
    return out.withColumn("split", split).drop("_r", "_r_n", "take_train", "take_valid", "_all")


def group_greedy_split(
    df: DataFrame, by: Sequence[str], group: str, key: str, train: float = 0.8, valid: float = 0.1
) -> DataFrame:
    """Groups by (size desc, first key desc) into train, valid, test; rows without a group are dropped."""
    if by:
        totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    else:
        totals = df.agg(F.count(F.lit(1)).alias("n"))
    groups = fill_by_size(_group_table(df, by, group, key), totals, by, [F.desc("first")], train, valid)
    return lookup(df.filter(F.col(group).isNotNull()), cut(groups.drop("size", "first")), [*by, group], F.col(key), "inner", null_safe=True)


def small_groups_to_test(df: DataFrame, by: Sequence[str], group: str, key: str, limit: Column, totals: DataFrame) -> DataFrame:
    """Smallest groups first into test while they fit under ``limit`` (over ``totals``), else train.

    Sizes only grow along the order, so the test groups are those whose running total stays below.
    """
    g = running_total(_group_table(df, by, group, key), "size", [F.col("size"), F.col("first")], by)
    g = attach(g, totals, by) if by else g.crossJoin(F.broadcast(totals))  # one row
    g = g.withColumn("split", F.when(F.col("below") + F.col("size") <= limit, "test").otherwise("train"))
    keep = [*by, group, "split"]
    return lookup(df.filter(F.col(group).isNotNull()), cut(g.select(*keep)), [*by, group], F.col(key), "inner", null_safe=True)


def group_test_first_split(df: DataFrame, by: Sequence[str], group: str, key: str, test: float = 0.2) -> DataFrame:
    """The greedy split without valid."""
    totals = (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("n"))
    return small_groups_to_test(df, by, group, key, F.lit(test) * F.col("n"), totals)


def gap_runs(sizes: Sequence[tuple[int, int]], gaps: Sequence[float]) -> list[tuple[int, int, list[int]]]:
    """Who takes the clusters of each size, largest size first, always the largest gap (the first of equal ones).

    ``sizes``: (size, number of clusters). Gives (size, first rank, takers), where the takers go round until
    the next run begins. A run stands for as many picks as keep their order, so the number of runs
    depends on the number of different sizes, not of clusters.
    """
    left, out = [Fraction(g) for g in gaps], []
    for size, count in sizes:
        at = 0
        while at < count:
            top, second, third = sorted(range(len(left)), key=lambda i: (-left[i], i))
            if left[top] - left[third] < size:
                takers, picks = [top, second, third], count - at  # all gaps within one size: they go round for good
            elif left[top] - left[second] >= size:
                takers, picks = [top], int((left[top] - left[second]) / size)
            elif left[second] - left[third] >= size:
                takers, picks = [top, second], 2 * int((left[second] - left[third]) / size)
            else:
                takers, picks = [top], 1
            picks = min(picks, count - at)
            out.append((size, at, takers))
            for k, i in enumerate(takers):
                left[i] -= size * ((picks - k + len(takers) - 1) // len(takers))
            at += picks
    return out


def gap_fill_split(df: DataFrame, cluster: str, key: str, train: float = 0.8, valid: float = 0.1, test: float = 0.1) -> DataFrame:
    """Given clusters, largest first, each to the split with the largest remaining gap.

    One task sees the table of different sizes; a cluster finds its split by its rank among those of its size.
    """
    clusters = cut(
        df.filter(F.col(cluster).isNotNull())
        .groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first"))
    )
    sizes = clusters.groupBy("size").agg(F.count(F.lit(1)).alias("n"))

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        n = int((pdf["size"] * pdf["n"]).sum())
        found = gap_runs(list(zip(pdf["size"].tolist(), pdf["n"].tolist())), [train * n, valid * n, test * n])
        out = pd.DataFrame(found, columns=["size", "from_rank", "takers"])
        return out.groupby("size", as_index=False).agg(list)

    schema = "size long, from_rank array<long>, takers array<array<int>>"
    takes = cut(sizes.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: runs(pdf.drop(columns="_all")), schema))
    ranked = attach(ordered_index(clusters, [F.col("first"), F.col(cluster)], ["size"], "_r"), takes, ["size"])
    at = F.size(F.filter("from_rank", lambda r: r <= F.col("_r")))
    takers = F.element_at("takers", at)
    own = F.element_at(takers, ((F.col("_r") - F.element_at("from_rank", at)) % F.size(takers) + 1).cast("int"))
    split = F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), own + 1)
    return lookup(df, cut(ranked.select(cluster, split.alias("split"))), [cluster], F.col(key), "inner")


# --- clusters by similarity -----------------------------------------------------------------------


def sphere_clusters(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cluster of every distinct set: centres are taken by (neighbours desc, id desc).

    ``sets`` from ``distinct_sets`` with ``last_id`` (largest member), ``pairs`` from
    ``similar_sets_within``. A node is decided once no undecided neighbour comes before it, so whole
    waves of centres are found per round. A round carries only the frontier: open nodes and the edges between two
    of them; what it decides is written once and not read again before the end. Copies count as neighbours.
    Gives first_id, centre_key, centre_degree, centre_id.
    """
    links = pairs.filter(F.col("l_id") != F.col("r_id"))
    edges = links.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    edges = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    weight = sets.select(F.col("first_id").alias("b"), F.col("n_members").alias("w"))
    degree = edges.join(weight, "b").groupBy("a").agg(F.sum("w").alias("d")).withColumnRenamed("a", "first_id")
    nodes = cut(
        sets.join(degree, "first_id", "left").select(
            "first_id",
            F.struct((F.coalesce("d", F.lit(0)) + F.col("n_members") - 1).alias("degree"), F.col("last_id").alias("id")).alias("p"),
        )
    )
    # every edge knows the places of both ends in the order, so a round needs no join with the nodes
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(nodes.select(F.col("first_id").alias(end), F.col("p").alias(f"p{end}")), end)
    open_edges = ends = stored(ends)
    lonely = nodes.join(edges.select(F.col("a").alias("first_id")).distinct(), "first_id", "left_anti")
    centres = [lonely]
    while not open_edges.isEmpty():
        # a centre comes before all its open neighbours; every round finds at least one
        best = open_edges.groupBy("a").agg(F.max("pb").alias("_best"), F.first("pa").alias("p"))
        found = cut(best.filter(F.col("p") > F.col("_best")).select(F.col("a").alias("first_id"), "p"))
        centres.append(found)
        reached = open_edges.join(found.select(F.col("first_id").alias("b")), "b", "left_semi").select(F.col("a").alias("first_id"))
        decided = cut(reached.unionByName(found.select("first_id")).distinct())
        left = open_edges
        for end in ("a", "b"):
            left = left.join(decided.select(F.col("first_id").alias(end)), end, "left_anti")
        left = cut(left)
        # open nodes that lost their last open neighbour, all of whose neighbours are covered, are centres too
        bare = open_edges.select(F.col("a").alias("first_id"), F.col("pa").alias("p")).distinct()
        bare = bare.join(decided, "first_id", "left_anti").join(left.select(F.col("a").alias("first_id")).distinct(), "first_id", "left_anti")
        centres.append(cut(bare))
        open_edges = left
    taken = reduce(lambda x, y: x.unionByName(y), centres)
    taken = cut(taken.select("first_id", "p"))
    joined = (
        ends.join(taken.select(F.col("first_id").alias("b")), "b", "left_semi")
        .groupBy("a")
        .agg(F.max(F.struct(F.col("pb").alias("q"), "b")).alias("c"))
        .select(F.col("a").alias("first_id"), "c")
    )
    own = taken.select("first_id", F.struct(F.col("p").alias("q"), F.col("first_id").alias("b")).alias("c"))
    rest = joined.join(taken.select("first_id"), "first_id", "left_anti")
    return own.unionByName(rest).select(
        "first_id", F.col("c.b").alias("centre_key"), F.col("c.q.degree").alias("centre_degree"), F.col("c.q.id").alias("centre_id")
    )


def cluster_greedy_split(members: DataFrame, clusters: DataFrame, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Fill by cluster size; equal sizes in the order the centres were taken.

    ``members``: one row per entity with its ``first_id``.
    """
    d = members.join(clusters, "first_id")
    groups = d.groupBy("centre_key").agg(
        F.count(F.lit(1)).alias("size"), F.first("centre_degree").alias("degree"), F.first("centre_id").alias("id")
    )
    totals = members.agg(F.count(F.lit(1)).alias("n"))
    filled = fill_by_size(groups, totals, [], [F.desc("degree"), F.desc("id")], train, valid)
    return d.join(filled.select("centre_key", "split"), "centre_key")


# --- per-endpoint driver and leakage repair ---------------------------------------------------------


def endpoint_split(
    df: DataFrame, by: Sequence[str], text: str, group: str, key: str, unseen_threshold: int, min_test: int = 30, seed: int = 0
) -> DataFrame:
    """Small endpoints are wholly unseen test; the others get about a tenth, at least ``min_test``.

    Adds ``split_type`` and ``split``. Rows without text are left out, and rows without a group in
    endpoints that are split. If the group fill leaves too few test rows and train is larger than
    the shortfall, the shortfall is moved from train in random order.
    """
    d = df.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    sizes = cut(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    small = sizes.filter(F.col("n") <= unseen_threshold)
    unseen = lookup(d, small, by, F.col(key), "inner", null_safe=True).drop("n").withColumns(
        {"split_type": F.lit("unseen_endpoint_test"), "split": F.lit("test")}
    )
    large = sizes.filter(F.col("n") > unseen_threshold).withColumn(
        "n_test",
        F.least(F.greatest(F.lit(min_test), F.bround(F.lit(0.1) * F.col("n"))), F.col("n") - 1),
    )
    rows = lookup(d, large, by, F.col(key), "inner", null_safe=True).drop("n", "n_test")
    filled = cut(small_groups_to_test(rows, by, group, key, F.col("n_test") / F.col("n") * F.col("n"), large))
    counts = filled.groupBy(*by).agg(
        F.count_if(F.col("split") == "test").alias("_nt"), F.count_if(F.col("split") == "train").alias("_na")
    )
    need = F.lit(min_test) - F.col("_nt")
    short = counts.withColumn("_need", F.when((need > 0) & (F.col("_na") > need), need).otherwise(0)).select(*by, "_need")
    train = hash_rank(filled.filter("split = 'train'"), seed, F.col(key), by, "_i")
    train = lookup(train, cut(short), by, F.col(key), "inner", null_safe=True)
    train = train.withColumn("split", F.when(F.col("_i") < F.col("_need"), "test").otherwise("train"))
    both = train.drop("_i", "_i_n", "_need").unionByName(filled.filter("split = 'test'"))
    return both.withColumn("split_type", F.lit("train_test")).unionByName(unseen)


def endpoint_split_summary(df: DataFrame, split: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Sizes per endpoint; endpoints without any text are listed as skipped."""
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.trim(F.coalesce(text, F.lit(""))) != "").alias("n_valid_repr"),
    )
    parts = split.groupBy(*by, "split_type").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    out = attach(totals, parts, by, "left").fillna(0, ["n_train", "n_test"])
    return out.withColumn("split_type", F.coalesce("split_type", F.lit("skip")))


def move_many_partner_rows(test: DataFrame, train: DataFrame, endpoint: str, entity: str, partner: str, at_least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Test rows of (endpoint, entity) with several distinct partners go to train."""
    many = (
        test.groupBy(endpoint, entity)
        .agg(F.countDistinct(partner).alias("_k"))
        .filter(F.col("_k") >= at_least)
        .select(endpoint, entity)
    )
    return move_flagged(test, train, many, [endpoint, entity])
