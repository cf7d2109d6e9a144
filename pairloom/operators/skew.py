"""Equi-join that spreads hot keys over a grid of tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut, shuffle_width

BROADCAST_KEYS = 200_000  # hot keys are broadcast only if counted to be at most this many
PAIR_SIDE = 4_000  # rows a side of a cell whose key has more than PAIR_SIDE * PAIR_SIDE pairs


def row_hash(df: DataFrame) -> Column:
    """A salt from all plain columns of a table, for joins whose rows have no id of their own."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    return F.xxhash64(*[F.col(c) for c in plain]) if plain else F.lit(0)


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_salt: Column,
    right_salt: Column,
    condition: Column | None = None,
    cell_rows: int = 20_000,
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join on ``keys`` where a key with many rows is cut into cells of ``cell_rows`` per side, one with many pairs
    into cells of ``PAIR_SIDE``: a task's time goes by its pairs.

    Rows per key are counted first (map-side combined). Without a hot key this is a plain join;
    otherwise a hot key's rows are dealt to rows and columns of a grid by hash, so every pair meets
    in exactly one cell and no task gets a whole hot key. Both inputs are read twice, so they
    should be written tables or cheap scans. Other columns of the two sides need different names.

    ``how="left"`` keeps left rows without a partner. There a key is hot by its left rows alone, and left
    rows with a NULL key, which match nothing, do not enter the join. With ``null_safe`` NULL keys are equal
    to each other. ``condition`` filters the joined rows of an inner join.
    """
    if how not in ("inner", "left") or (how == "left" and condition is not None):
        raise ValueError("grid_join is an inner join, or a left join without a condition")
    loose = None
    on = list(keys)
    if null_safe:
        key = F.struct(*keys)  # structs compare their NULL fields as equal
        left, right, on = left.withColumn("_key", key), right.withColumn("_key", key).drop(*keys), ["_key"]
    elif how == "left":
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        loose, left = left.filter(~whole), left.filter(whole)
    joined = _dealt(left, right, on, left_salt, right_salt, cell_rows, how)
    if loose is not None:
        joined = joined.unionByName(loose, allowMissingColumns=True)
    if null_safe:
        joined = joined.drop("_key")
    return joined if condition is None else joined.filter(condition)


def lookup(
    df: DataFrame, table: DataFrame, keys: Sequence[str], salt: Column, how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join with a table of one row a key: broadcast only if counted to be small, else dealt as a grid.

    ``table`` is counted first, so it should be written or cheap; ``salt`` is any column of ``df`` that spreads its rows.
    """
    if table.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        if not null_safe:
            return df.join(F.broadcast(table), list(keys), how)
        key = F.struct(*keys)
        joined = df.withColumn("_key", key).join(F.broadcast(table.withColumn("_key", key).drop(*keys)), "_key", how)
        return joined.drop("_key")
    return grid_join(df, table, keys, salt, F.lit(0), how=how, null_safe=null_safe)


def _dealt(
    left: DataFrame, right: DataFrame, keys: list[str], left_salt: Column, right_salt: Column, cell_rows: int, how: str
) -> DataFrame:
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    pair_side = min(cell_rows, PAIR_SIDE)
    many_pairs = F.col("_nl").cast("double") * F.col("_nr") > pair_side * pair_side
    large = (F.col("_nl") > cell_rows) | (F.col("_nr") > cell_rows) | many_pairs
    wanted = (F.col("_nl") > 0) & large
    if how == "inner":
        wanted = wanted & (F.col("_nr") > 0)
    cells = lambda n: F.greatest(F.ceil(F.col(n) / F.when(many_pairs, pair_side).otherwise(cell_rows)), F.lit(1)).cast("int")
    one = F.lit(1)
    hot = cut(
        sides.groupBy(*keys)
        .agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
        .filter(wanted)
        .select(*keys, cells("_nl").alias("_gl"), cells("_nr").alias("_gr"), (F.col("_nr") > 0).alias("_met"))
    )  # at most rows / pair_side keys
    n_hot, n_cells = hot.agg(F.count(one), F.sum(F.col("_gl").cast("long") * F.col("_gr"))).first()
    if n_hot == 0:
        return left.join(right, keys, how)
    if n_hot <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    lhs = left.join(hot, keys, "left")
    lhs = (
        lhs.withColumn("_cl", F.pmod(F.xxhash64(left_salt), F.coalesce("_gl", one)).cast("int"))
        .withColumn("_cr", F.explode(F.sequence(F.lit(0), F.coalesce("_gr", one) - 1)))
        .drop("_gl", "_gr")
    )
    rhs = right.join(hot.drop("_met"), keys, "left")
    rhs = (
        rhs.withColumn("_cr", F.pmod(F.xxhash64(right_salt), F.coalesce("_gr", one)).cast("int"))
        .withColumn("_cl", F.explode(F.sequence(F.lit(0), F.coalesce("_gl", one) - 1)))
        .drop("_gl", "_gr")
    )
    on = [*keys, "_cl", "_cr"]
    width = shuffle_width(left.sparkSession)
    if n_cells > width:  # a cell has few bytes for its pairs, so small partitions must not be put together
        lhs, rhs = (d.repartition(4 * width, *on) for d in (lhs, rhs))
    if how == "left":
        # a hot key's rows meet their partners in other cells too: an empty cell is no missing partner
        out = lhs.join(rhs.withColumn("_hit", F.lit(True)), on, "left")
        out = out.filter(F.col("_hit").isNotNull() | ~F.coalesce("_met", F.lit(False))).drop("_hit")
    else:
        out = lhs.join(rhs, on)
    return out.drop("_cl", "_cr", "_met")
