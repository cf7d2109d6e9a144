"""Counts, censuses, fences, distributions and pooled comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordering import attach, exact_quantiles, ordered_index
from pairloom.operators.ranking import top_per_group
from pairloom.operators.skew import lookup
from pairloom.session import cut

TOTAL = "total"


def pair_counts(pairs: DataFrame, left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of similar pairs per block with both side sizes; blocks without pairs count 0."""
    sides = attach(
        left.groupBy(*by).agg(F.sum("n_members").alias("n_pos")),
        right.groupBy(*by).agg(F.sum("n_members").alias("n_neg")),
        by,
    )
    found = pairs.groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"))
    return attach(sides, found, by, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def condition_counts(
    pairs: DataFrame, by: Sequence[str], conditions: dict[str, Column], weight: Column | None = None
) -> DataFrame:
    """How many pairs meet each condition, per block and in total (block names become ``total``).

    With ``weight`` a row stands for that many pairs.
    """
    if weight is None:
        counts = [F.count_if(c).alias(n) for n, c in conditions.items()]
    else:
        counts = [F.sum(F.when(c, weight).otherwise(0)).alias(n) for n, c in conditions.items()]
    rolled = pairs.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(
        *counts, F.grouping_id().alias("_g")
    )
    names = {c: F.when(F.col("_g") > 0, TOTAL).otherwise(F.col(c)) for c in by}
    return rolled.withColumns(names).drop("_g")


def threshold_table(
    pairs: DataFrame, block: str, twentieths: Sequence[int], tags: Mapping[str, Column]
) -> DataFrame:
    """Pairs at or above each threshold (in twentieths) as columns, per block and in total.

    ``tags``: column prefix -> which pairs count there, so several measures of one pair table stand side by side.
    """
    w, i, u = F.col("n_pairs"), F.col("n_common"), F.col("n_union")
    cols = [
        F.sum(F.when(which & (i * 20 >= u * t), w).otherwise(0)).alias(f"{tag}_{t * 5:03d}")
        for tag, which in tags.items()
        for t in twentieths
    ]
    rolled = pairs.rollup(block).agg(*cols, F.grouping_id().alias("_g"))
    return rolled.withColumn(block, F.when(F.col("_g") > 0, TOTAL).otherwise(F.col(block))).drop("_g")


def long_properties(df: DataFrame, properties: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, property): property, value."""
    d = df.select(*keep, *[F.col(p).cast("double").alias(p) for p in properties])
    return d.unpivot(list(keep), list(properties), "property", "value")


def iqr_fences(df: DataFrame, properties: Sequence[str], k: float = 1.5) -> DataFrame:
    """Exact quartiles and Tukey fences, one row per property (a bounded table)."""
    q = exact_quantiles(
        long_properties(df, properties), "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["property"]
    )
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        "property",
        "n_values",
        "q1",
        "median",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - k * iqr).alias("lower_fence"),
        (F.col("q3") + k * iqr).alias("upper_fence"),
    )


def flag_outliers(df: DataFrame, fences: DataFrame, properties: Sequence[str]) -> DataFrame:
    """``is_outlier_<p>`` and ``is_outlier``: strictly outside the fences; NULL values are inside."""
    wide = fences.groupBy().pivot("property", list(properties)).agg(
        F.first(F.struct("lower_fence", "upper_fence"))
    )
    one = F.broadcast(wide.select(*[F.col(p).alias(f"_f_{p}") for p in properties]))  # a single row
    d = df.crossJoin(one)
    for p in properties:
        x, f = F.col(p), F.col(f"_f_{p}")
        out = F.coalesce((x < f["lower_fence"]) | (x > f["upper_fence"]), F.lit(False))
        d = d.withColumn(f"is_outlier_{p}", out)
    any_out = F.greatest(*[F.col(f"is_outlier_{p}") for p in properties]) if len(properties) > 1 else F.col(
        f"is_outlier_{properties[0]}"
    )
    return d.withColumn("is_outlier", any_out).drop(*[f"_f_{p}" for p in properties])


def outlier_counts(flagged: DataFrame, properties: Sequence[str], by: str) -> DataFrame:
    """Outliers and their share per block and overall."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if("is_outlier").alias("n_outliers")]
    aggs += [F.count_if(f"is_outlier_{p}").alias(f"n_{p}") for p in properties]
    d = flagged.rollup(by).agg(*aggs, F.grouping_id().alias("_g"))
    d = d.withColumn(by, F.when(F.col("_g") > 0, TOTAL).otherwise(F.col(by))).drop("_g")
    return d.withColumn("outlier_ratio", F.col("n_outliers") / F.col("n_rows"))


def length_cut(lengths: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Integer outlier cut floor(q3 + k*iqr) + 1 with count, rate, min, max and mean (one row)."""
    counts = lengths.groupBy(column).agg(F.count(F.lit(1)).alias("_w"))
    q = exact_quantiles(lengths, column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    one = q.withColumn("upper_fence", F.col("q3") + k * (F.col("q3") - F.col("q1"))).withColumn(
        "cut", (F.floor("upper_fence") + 1).cast("long")
    )
    d = counts.crossJoin(F.broadcast(one))  # one row
    x, w = F.col(column), F.col("_w")
    return d.groupBy("q1", "median", "q3", "upper_fence", "cut").agg(
        F.sum(w).alias("n"),
        F.sum(F.when(x >= F.col("cut"), w).otherwise(0)).alias("n_outliers"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.sum(x * w) / F.sum(w)).alias("mean"),
    ).withColumn("outlier_rate", F.col("n_outliers") / F.col("n"))


def length_bin(x: Column) -> Column:
    """Length bins [0,5) [5,10) [10,20) [20,50) [50,10000]."""
    return (
        F.when(x < 5, "[0,5)").when(x < 10, "[5,10)").when(x < 20, "[10,20)").when(x < 50, "[20,50)").otherwise("[50,10000]")
    )


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population std, min, max and exact median of a numeric column."""
    base = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = exact_quantiles(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, by).drop("n_values")
    return attach(base, q, by) if by else base.crossJoin(F.broadcast(q))  # one row each


def partner_stats(pairs: DataFrame, endpoint: str, entity: str, partner: str) -> DataFrame:
    """Rows and distinct partners per (endpoint, entity)."""
    return pairs.groupBy(endpoint, entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(partner).alias("n_partners")
    )


def many_partner_summary(pairs: DataFrame, endpoint: str, entity: str, partner: str, at_least: int = 2) -> DataFrame:
    """Share of rows whose entity has several partners, per endpoint and overall."""
    many = F.col("n_partners") >= at_least
    d = partner_stats(pairs, endpoint, entity, partner).rollup(endpoint).agg(
        F.sum("n_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(many).alias("n_many"),
        F.sum(F.when(many, F.col("n_rows")).otherwise(0)).alias("rows_from_many"),
        F.grouping_id().alias("_g"),
    )
    d = d.withColumn(endpoint, F.when(F.col("_g") > 0, TOTAL).otherwise(F.col(endpoint))).drop("_g")
    return d.withColumn("ratio", F.col("rows_from_many") / F.col("total_rows"))


def census(
    df: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str], count: str, distinct: dict[str, str]
) -> DataFrame:
    """GROUPING SETS with a row count and numbers of distinct values (``distinct``: name -> column).

    ``grouping`` says which columns are rolled up (a bit per column). A value's cells are collected before they are
    rolled up, so a value is a key once and not once for every set; only the cells themselves are keys after that.
    """
    kinds = dict(df.dtypes)

    def key(cell, chosen: Sequence[str]) -> Column:
        rolled = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in chosen)
        own = [(cell(c) if c in chosen else F.lit(None).cast(kinds[c])).alias(c) for c in columns]
        return F.struct(*own, F.lit(rolled).cast("long").alias("grouping"))

    def rolled_to(chosen: Sequence[str]):
        return lambda cell: key(lambda c: cell[c], chosen)

    def counted(keyed: DataFrame, name: str, value: Column) -> DataFrame:
        zero = F.lit(0).cast("long")
        return keyed.select("_k.*", *((value if c == name else zero).alias(c) for c in (count, *distinct)))

    cells = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    out = counted(cells.select(F.explode(F.array(*(key(F.col, s) for s in sets))).alias("_k"), "_n"), count, F.col("_n"))
    for name, column in distinct.items():
        held = df.filter(F.col(column).isNotNull()).select(*columns, F.col(column).alias("_v")).distinct()
        held = held.groupBy("_v").agg(F.collect_list(F.struct(*columns)).alias("_cells"))
        keys = F.concat(*(F.array_distinct(F.transform("_cells", rolled_to(s))) for s in sets))
        out = out.unionByName(counted(held.select(F.explode(keys).alias("_k")), name, F.lit(1).cast("long")))
    sums = [F.sum(c).alias(c) for c in (count, *distinct)]
    return out.groupBy(*columns, "grouping").agg(*sums).select(*columns, count, *distinct, "grouping")


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).fillna(0, list(values))


def dataset_table(df: DataFrame, rows: Sequence[str], dataset: str, order: Sequence[str]) -> DataFrame:
    """Counts per row label with one column per dataset in fixed order and a total."""
    d = df.groupBy(*rows).pivot(dataset, list(order)).agg(F.count(F.lit(1))).fillna(0, list(order))
    total = F.lit(0)
    for c in order:
        total = total + F.col(c)
    return d.withColumn("total", total)


def split_summary(summary: DataFrame) -> DataFrame:
    """Per dataset: endpoints, summed sizes, split ratios and how many endpoints are small."""
    n = F.col("n_total")
    bins = {
        "lt5": n < 5,
        "lt10": (n >= 5) & (n < 10),
        "lt30": (n >= 10) & (n < 30),
        "lt100": (n >= 30) & (n < 100),
        "ge100": n >= 100,
    }
    d = summary.groupBy("dataset_name").agg(
        F.count("endpoint").alias("n_endpoints"),
        *[F.sum(f"n_{c}").alias(f"sum_{c}") for c in ("total", "train", "valid", "test")],
        *[F.count_if(c).alias(f"size_{b}") for b, c in bins.items()],
    )
    base = F.when(F.col("sum_total") == 0, 1).otherwise(F.col("sum_total"))
    return d.withColumns({f"{c}_ratio": F.col(f"sum_{c}") / base for c in ("train", "valid", "test")})


def metric_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means whose denominator is the row count, NULL metrics included; NULL if a metric never occurs."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    aggs = [F.count(F.lit(1)).alias("total"), F.sum("correct").alias("n_correct")]
    aggs += [(F.sum(m) / n).alias(m) for m in metrics]
    return df.groupBy(*by).agg(*aggs).withColumn("accuracy", F.col("n_correct") / F.col("total"))


def reason_histogram(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.filter(F.col("reason").isNotNull()).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def reason_examples(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int = 24) -> DataFrame:
    """First k failing rows per group."""
    return top_per_group(df.filter(F.col("reason").isNotNull()), by, [F.col(c) for c in order], k, "n")


def agreement(a: Column, b: Column) -> Column:
    """Share of rows with both values whose rounded 0/1 agree."""
    both = a.isNotNull() & b.isNotNull()
    return F.avg(F.when(both, (F.bround(a) == F.bround(b)).cast("double")))


def paired_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means that ignore NULL, differences of means, agreement and mismatch rates (t1, t2 against t3)."""
    e1, e2, e3, b3 = (F.col(c) for c in ("t1_em", "t2_em", "t3_em", "t3_bleu"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_paired"),
        F.avg(e1).alias("mean_t1"),
        F.avg(e2).alias("mean_t2"),
        F.avg(e3).alias("mean_t3"),
        agreement(e1, e3).alias("agreement_t1"),
        agreement(e2, b3).alias("agreement_t2"),
        (F.avg(e3) - F.avg(e1)).alias("mean_delta_t1"),
        (F.avg(b3) - F.avg(e2)).alias("mean_delta_t2"),
        F.avg(F.col("meta_mismatch").cast("double")).alias("mismatch_rate"),
    )


def outcome_table(a: Column, b: Column) -> list[Column]:
    """The four counts of two 0/1 outcomes, NULL rows left out."""
    x, y = F.bround(a), F.bround(b)
    return [
        F.count_if((x == 1) & (y == 1)).alias("both_1"),
        F.count_if((x == 0) & (y == 0)).alias("both_0"),
        F.count_if((x == 1) & (y == 0)).alias("first_only"),
        F.count_if(a.isNotNull() & b.isNotNull() & ~((x == 1) & (y == 1)) & ~((x == 0) & (y == 0)) & ~((x == 1) & (y == 0))).alias(
            "second_only"
        ),
    ]


def joint_outcomes(df: DataFrame, by: Sequence[str], final: str, steps: Sequence[str]) -> DataFrame:
    """Share of each combination of step outcomes within each final outcome."""
    d = df.dropna(subset=[final, *steps])
    d = d.select(*by, *[F.bround(c).cast("int").alias(c) for c in (final, *steps)])
    joint = d.groupBy(*by, final, *steps).agg(F.count(F.lit(1)).alias("count"))
    totals = joint.groupBy(*by, final).agg(F.sum("count").alias("_t"))
    return attach(joint, totals, [*by, final]).withColumn("frac", F.round(F.col("count") / F.col("_t"), 6)).drop("_t")


def marginal_outcomes(df: DataFrame, by: Sequence[str], final: str, steps: Sequence[str]) -> DataFrame:
    """Share of 0 and 1 per step within each final outcome; combinations that do not occur count 0."""
    joint = joint_outcomes(df, by, final, steps)
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("em")) for s in steps]))
    seen = (
        joint.select(*by, final, "count", cells.alias("c"))
        .groupBy(*by, final, "c.step", "c.em")
        .agg(F.sum("count").alias("count"))
    )
    values = F.array(F.lit(0), F.lit(1))
    grid = (
        df.select(*by)
        .distinct()
        .withColumn(final, F.explode(values))
        .withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
        .withColumn("em", F.explode(values))
    )
    full = attach(grid, seen, [*by, final, "step", "em"], "left").fillna(0, ["count"])
    totals = full.groupBy(*by, final, "step").agg(F.sum("count").alias("_t"))
    return (
        attach(full, totals, [*by, final, "step"])
        .withColumn("frac", F.when(F.col("_t") > 0, F.round(F.col("count") / F.col("_t"), 6)).otherwise(0.0))
        .drop("_t")
    )


def pooled(df: DataFrame, by: str, weight: str, means: Sequence[str]) -> DataFrame:
    """Weighted means over models per variant and over everything; NULL values carry no weight."""
    w = F.col(weight).cast("double")
    aggs = [F.count(F.lit(1)).alias("n_models"), F.sum(weight).alias(weight)]
    for m in means:
        x = F.col(m)
        aggs.append((F.sum(x * w) / F.sum(F.when(x.isNotNull() & (w > 0), w))).alias(m))
    d = df.rollup(by).agg(*aggs, F.grouping_id().alias("_g"))
    return d.withColumn(by, F.when(F.col("_g") > 0, "all (pooled)").otherwise(F.col(by))).drop("_g")


def top_vocabulary(df: DataFrame, counts: str, k: int = 10) -> DataFrame:
    """Most frequent names of a name -> count map."""
    d = df.select(F.explode(counts).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
    return d.orderBy(F.desc("n"), "name").limit(k)


def feature_counts(df: DataFrame, key: str, counts: str) -> DataFrame:
    """The matrix over the whole vocabulary in long form: key, name, n; absent names have no row."""
    return df.select(key, F.explode(counts).alias("name", "n"))


def vocabulary(df: DataFrame, counts: str) -> DataFrame:
    """name, idx: every name of a name -> count map, numbered from 0 in alphabetical order."""
    names = df.select(F.explode(F.map_keys(counts)).alias("name")).distinct()
    return ordered_index(names, [F.col("name")], name="idx").select("name", "idx")


def sparse_matrix(df: DataFrame, key: str, counts: str, words: DataFrame) -> DataFrame:
    """key, indices, counts, n_names: each row's names as positions in the vocabulary; n_names is its length."""
    long = df.select(key, F.explode_outer(counts).alias("name", "n"))
    placed = lookup(long, words, ["name"], F.col(key))
    size = words.agg(F.count(F.lit(1)).alias("n_names"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "n"))))  # one row's names
    d = placed.groupBy(key).agg(pairs.alias("_p")).crossJoin(F.broadcast(size))  # one row
    return d.select(key, F.col("_p.idx").alias("indices"), F.col("_p.n").alias("counts"), "n_names")


def dense_rows(matrix: DataFrame, key: str) -> DataFrame:
    """key, vector: counts over the whole vocabulary, 0 where absent."""
    by_index = F.map_from_arrays("indices", "counts")
    zero = F.lit(0).cast(matrix.schema["counts"].dataType.elementType)
    value = lambda i: F.coalesce(F.try_element_at("_m", i), zero)
    all_of = F.when(F.col("n_names") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_names") - 1)).otherwise(F.array().cast("array<bigint>"))
    return matrix.withColumn("_m", by_index).select(key, F.transform(all_of, value).alias("vector"))


def wide_groups(matrix: DataFrame, key: str, words: DataFrame, width: int = 1000) -> Iterator[DataFrame]:
    """The matrix with one column a name, in tables of at most ``width`` columns that share the key.

    Only a table's own column names come to the driver, one table at a time.
    """
    total = words.count()
    by_index = F.map_from_arrays("indices", "counts")
    for start in range(0, total, width):
        own = words.filter((F.col("idx") >= start) & (F.col("idx") < start + width)).orderBy("idx").collect()
        columns = [F.coalesce(F.try_element_at("_m", F.lit(r.idx)), F.lit(0)).alias(r.name) for r in own]
        yield matrix.withColumn("_m", by_index).select(key, *columns)


def density_histogram(df: DataFrame, value: str, by: str, bins: int = 40) -> DataFrame:
    """Density of equal-width bins between a group's min and max, with the group mean."""
    x = F.col(value)
    stats = df.filter(x.isNotNull()).groupBy(by).agg(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.count(x).alias("n_total")
    )
    # the counted table of groups goes to the rows, and rows are counted where they are before anything is moved
    d = lookup(df.filter(x.isNotNull()).select(by, value), cut(stats), [by], x, "inner", null_safe=True)
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(width == 0, 0).otherwise(F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = d.groupBy(by, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("lo", "hi", "mean", "n_total")]
    )
    return counted.withColumn("density", F.col("n") / (F.col("n_total") * width)).drop("lo", "hi", "n_total")
