"""Set operations and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import setops as U
from pairloom.operators.rowdiff import feature_name_diff
from pairloom.plans.frames import SQL_TRADES, SQL_TURNS, trades, turns
from pairloom.plans.part_pairs import SQL_PART_PAIRS, part_pairs
from pairloom.plans.q_filters import SQL_CODES, compared
from pairloom.plans.registry import query, table


@query(
    "U1_union_common_columns",
    """SELECT key, name, count(*) AS n FROM (SELECT s_suppkey AS key, s_name AS name FROM supplier
      UNION ALL SELECT c_custkey, c_name FROM customer) GROUP BY ALL""",
)
def u1(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    return U.union_common(s, c).groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "U2_union_all_columns",
    """SELECT s_suppkey AS key, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
    UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""",
)
def u2(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return U.union_all_columns(s, c)


@query(
    "U3_distinct_entities",
    f"""WITH {SQL_TURNS} SELECT DISTINCT e AS entity FROM (SELECT trim(left_repr) AS e FROM turns
      UNION ALL SELECT trim(right_repr) FROM turns) WHERE e <> ''""",
)
def u3(spark, sf):
    return U.entities_of(turns(spark, sf))


@query(
    "U4_distinct_pairs",
    f"WITH {SQL_TRADES} SELECT DISTINCT dataset_name, endpoint, left_id, right_id FROM trades",
)
def u4(spark, sf):
    return trades(spark, sf).select("dataset_name", "endpoint", "left_id", "right_id").dropDuplicates()


@query(
    "U5_merge_sources",
    """WITH d AS (SELECT row_number() OVER () AS z, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
        l_returnflag AS src, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'p' || l_partkey END AS l,
        CASE WHEN l_suppkey % 3 = 0 THEN 'p' || (l_suppkey * 2 + 1) ELSE 's' || l_suppkey END AS r FROM lineitem),
    bad AS (SELECT l AS e FROM d WHERE l <> '' INTERSECT SELECT r FROM d),
    ok AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY src, row_id) AS rn FROM d
      WHERE l <> '' AND l NOT IN (SELECT e FROM bad) AND r NOT IN (SELECT e FROM bad))
    SELECT l AS left_repr, r AS right_repr, src, 'merged' AS dataset_name, 'joint' AS endpoint FROM ok WHERE rn = 1""",
)
def u5(spark, sf):
    d = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_returnflag").alias("src"),
        F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("p"), "l_partkey")).alias("left_repr"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("p"), F.col("l_suppkey") * 2 + 1))
        .otherwise(F.concat(F.lit("s"), "l_suppkey"))
        .alias("right_repr"),
    )
    return U.merge_sources(d, ["src", "row_id"], "left_repr", "right_repr", "merged", "joint").drop("row_id")


@query(
    "U6_fragment_comparison",
    f"""WITH {SQL_CODES} SELECT source_index, array_to_string(list_sort(a), '.') AS left_fragments,
      array_to_string(list_sort(b), '.') AS right_fragments, common, only_left, only_right,
      CAST(n_common AS INTEGER) AS n_common, CAST(n_only_left AS INTEGER) AS n_only_left, CAST(n_only_right AS INTEGER) AS n_only_right,
      n_only_left > 0 OR n_only_right > 0 AS has_diff,
      '[' || array_to_string(list_concat(list_transform(list_sort(l), lambda x: '{{"fragment":"' || x || '","side":"left"}}'),
         list_transform(list_sort(r), lambda x: '{{"fragment":"' || x || '","side":"right"}}')), ',') || ']' AS unique_json FROM cmp""",
)
def u6(spark, sf):
    return compared(spark, sf).select(
        "source_index", "left_fragments", "right_fragments", "common", "only_left", "only_right",
        "n_common", "n_only_left", "n_only_right", "has_diff", "unique_json",
    )


@query(
    "U7_feature_name_diff",
    f"""WITH {SQL_PART_PAIRS}, u AS (SELECT pair_id, unnest(list_sort(list_concat(
        list_filter(l_names, lambda x: NOT list_contains(r_names, x)), list_filter(r_names, lambda x: NOT list_contains(l_names, x))))) AS fg_name FROM part_pairs)
    SELECT pair_id, fg_name, CASE WHEN list_contains(l_names, fg_name) THEN 'left_only' ELSE 'right_only' END AS reason,
      CAST(CASE WHEN list_contains(l_names, fg_name) THEN len(list_filter(l_words, lambda x: x = fg_name)) ELSE len(list_filter(r_words, lambda x: x = fg_name)) END AS INTEGER) AS n_positions
    FROM u JOIN part_pairs USING (pair_id)""",
)
def u7(spark, sf):
    p = feature_name_diff(part_pairs(spark, sf))
    return p.select("pair_id", F.explode("unique_fg").alias("u")).select(
        "pair_id",
        "u.fg_name",
        "u.reason",
        (F.coalesce(F.size("u.left_positions"), F.lit(0)) + F.coalesce(F.size("u.right_positions"), F.lit(0))).alias("n_positions"),
    )


@query(
    "U8_common_ids",
    """SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')
      AND l_orderkey IN (SELECT event_id FROM events)""",
)
def u8(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    b = table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("id"))
    c = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return U.common_ids([a, b], "id", c)
