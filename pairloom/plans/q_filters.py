"""Filters and predicates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.sets import fragments, words
from pairloom.functions.strings import plain_placeholders
from pairloom.operators import filters as P
from pairloom.operators.setops import compare_fragments
from pairloom.plans.frames import (
    SQL_FRAGMENTS,
    SQL_LABELLED,
    SQL_TRADES,
    SQL_TURNS,
    SQL_WORDS,
    TRADE_PROPS,
    trades,
    turns,
)
from pairloom.plans.part_pairs import SQL_CASE_PAIRS, case_pairs
from pairloom.plans.registry import query, table

# words joined by dots stand in for a fragment code; both engines see the same text
SQL_CODES = f"""{SQL_TURNS}, codes AS (
  SELECT *, array_to_string(list_sort({SQL_WORDS.format('left_repr')}), '.') AS left_code,
         array_to_string(list_sort({SQL_WORDS.format('right_repr')}), '.') AS right_code FROM turns),
compared AS (
  SELECT *, list_intersect(a, b) AS c, list_filter(a, lambda x: NOT list_contains(b, x)) AS l,
         list_filter(b, lambda x: NOT list_contains(a, x)) AS r
  FROM (SELECT *, {SQL_WORDS.format('left_repr')} AS a, {SQL_WORDS.format('right_repr')} AS b FROM codes)),
cmp AS (
  SELECT source_index, dataset_name, endpoint, len(c) AS n_common, len(l) AS n_only_left, len(r) AS n_only_right,
         array_to_string(list_sort(c), '.') AS common, array_to_string(list_sort(l), '.') AS only_left,
         array_to_string(list_sort(r), '.') AS only_right, a, b, c, l, r FROM compared)"""


def codes(spark, sf):
    t = turns(spark, sf)
    return t.withColumns(
        {f"{s}_code": F.array_join(F.sort_array(words(F.col(f"{s}_repr"))), ".") for s in ("left", "right")}
    )


def compared(spark, sf):
    return compare_fragments(codes(spark, sf), "left_code", "right_code")


@query(
    "P1_comparable_pairs",
    f"""WITH {SQL_CODES} SELECT source_index, CAST(n_common AS INTEGER) AS n_common,
      CAST(n_only_left AS INTEGER) AS n_only_left, CAST(n_only_right AS INTEGER) AS n_only_right
    FROM cmp WHERE n_common <> 0 AND NOT (n_only_left = 0 AND n_only_right = 0)
      AND len(list_filter(l, lambda x: length(x) >= 14)) = 0 AND len(list_filter(r, lambda x: length(x) >= 14)) = 0
      AND n_only_left <= 60 AND n_only_right <= 60""",
)
def p1(spark, sf):
    # the rules' limits are parameters; words need other limits than chemical fragments (28 and 4)
    return P.keep_comparable_pairs(compared(spark, sf), max_frag_len=14, max_frag_num=60).select(
        "source_index", "n_common", "n_only_left", "n_only_right"
    )


@query(
    "P2_long_fragment_drop",
    f"""WITH d AS (SELECT doc_id, {SQL_FRAGMENTS.format('text')} AS f FROM documents)
    SELECT doc_id, array_to_string(list_filter(f, lambda x: length(x) <= 60), '.') AS trimmed FROM d
    WHERE len(list_filter(f, lambda x: length(x) >= 120)) = 0""",
)
def p2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return P.drop_long_fragments(d, ["text"], 120).select(
        "doc_id", P.trim_fragments(F.col("text"), 60).alias("trimmed")
    )


@query(
    "P3_fragment_count_drop",
    f"""SELECT doc_id, CAST(len({SQL_FRAGMENTS.format('text')}) AS INTEGER) AS n_fragments FROM documents
    WHERE len({SQL_FRAGMENTS.format('text')}) <= 4""",
)
def p3(spark, sf):
    d = table(spark, sf, "documents")
    return P.drop_many_fragments(d, ["text"], 4).select(
        "doc_id", F.size(fragments(F.col("text"))).alias("n_fragments")
    )


@query(
    "P4_single_component",
    f"""SELECT page_id, strpos(url, '.') > 0 AS dotted,
      len(list_filter({SQL_FRAGMENTS.format('url')}, lambda x: length(x) >= 3
          AND NOT (starts_with(x, '[') AND ends_with(x, ']') AND length(x) < 10))) > 1 AS several FROM pages""",
)
def p4(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", P.has_dot(u).alias("dotted"), P.has_several_components(u).alias("several")
    )


def kinds(spark, sf):
    """Difference counts of adjacent turns: words only on one side, and sentence-count gap."""
    c = compared(spark, sf)
    gap = F.abs(F.size(fragments(F.col("left_repr"))) - F.size(fragments(F.col("right_repr"))))
    return c.select(
        "source_index",
        (F.col("n_only_left") % 3).alias("n_fg_diff"),
        (gap % 3).alias("n_stereo_diff"),
    ).withColumn("n_diff_features", F.col("n_fg_diff") + F.col("n_stereo_diff"))


SQL_KINDS = f"""{SQL_CODES}, kinds0 AS (
  SELECT t.source_index, CAST(n_only_left % 3 AS INTEGER) AS n_fg_diff,
    CAST(abs(len({SQL_FRAGMENTS.format('left_repr')}) - len({SQL_FRAGMENTS.format('right_repr')})) % 3 AS INTEGER) AS n_stereo_diff
  FROM turns t JOIN cmp USING (source_index)),
kinds AS (SELECT *, n_fg_diff + n_stereo_diff AS n_diff_features FROM kinds0)"""


@query("P5_exactly_one_difference", f"WITH {SQL_KINDS} SELECT source_index, n_fg_diff, n_stereo_diff FROM kinds WHERE n_diff_features = 1")
def p5(spark, sf):
    return P.exactly_one_difference(kinds(spark, sf)).select("source_index", "n_fg_diff", "n_stereo_diff")


@query(
    "P6_select_kind",
    f"WITH {SQL_KINDS} SELECT source_index FROM kinds WHERE n_fg_diff > 0 AND n_stereo_diff > 0 AND n_diff_features > 1",
)
def p6(spark, sf):
    return P.select_kind(kinds(spark, sf), "both", "multi_step").select("source_index")


@query(
    "P7_classify",
    f"""WITH {SQL_KINDS} SELECT source_index, CASE WHEN n_fg_diff > 0 AND n_stereo_diff > 0 THEN 'both'
      WHEN n_fg_diff > 0 THEN 'only_fg' WHEN n_stereo_diff > 0 THEN 'only_stereo' ELSE 'none' END AS diff_type,
      CASE WHEN n_diff_features = 1 THEN 'one_step' ELSE 'multi_step' END AS step_num FROM kinds""",
)
def p7(spark, sf):
    return kinds(spark, sf).select(
        "source_index",
        P.pair_type(F.col("n_fg_diff"), F.col("n_stereo_diff")).alias("diff_type"),
        P.pair_step(F.col("n_diff_features")).alias("step_num"),
    )


@query(
    "P8_step_of_fragments",
    f"""WITH {SQL_TURNS} SELECT source_index, CASE WHEN greatest(len({SQL_FRAGMENTS.format('left_repr')}),
      len({SQL_FRAGMENTS.format('right_repr')})) >= 2 THEN 'multi_step' ELSE 'single_step' END AS step FROM turns""",
)
def p8(spark, sf):
    return turns(spark, sf).select(
        "source_index", P.step_of_fragments(F.col("left_repr"), F.col("right_repr")).alias("step")
    )


@query(
    "P9_drop_unplaced",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS dataset_name,
      nullif(l_linestatus, 'O') AS endpoint FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')""",
)
def p9(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("dataset_name"),
        F.nullif("l_linestatus", F.lit("O")).alias("endpoint"),
    )
    return P.drop_unplaced(li)


@query(
    "P10_task_families",
    "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'ECO') OR starts_with(p_type, 'PRO')",
)
def p10(spark, sf):
    return P.of_task_families(table(spark, sf, "part"), ["ECO", "PRO"], "p_type").select("p_partkey", "p_type")


@query(
    "P11_property_delta",
    """WITH a AS (SELECT l_orderkey, l_linenumber, p_retailprice AS left_price, s_acctbal AS right_price,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS left_size, CAST(s_nationkey AS INTEGER) AS right_size
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT l_orderkey, l_linenumber, round(sum(left_price - right_price), 4) AS delta_price,
      round(sum(abs(left_price - right_price)), 4) AS delta_abs_price,
      CAST(sum(left_size - right_size) AS BIGINT) AS delta_size, CAST(sum(abs(left_size - right_size)) AS BIGINT) AS delta_abs_size
    FROM a GROUP BY ALL""",
)
def p11(spark, sf):
    """Per-entity property tables joined to both sides of the trade pairs, then differenced."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id")
    )
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("left_id"),
        F.col("p_retailprice").alias("left_price"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("left_size"),
    )
    supp = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("right_id"), F.col("s_acctbal").alias("right_price"), F.col("s_nationkey").alias("right_size")
    )
    d = P.property_deltas(li.join(part, "left_id").join(supp, "right_id"), ["price", "size"])
    return d.groupBy("l_orderkey", "l_linenumber").agg(
        F.round(F.sum("delta_price"), 4).alias("delta_price"),
        F.round(F.sum("delta_abs_price"), 4).alias("delta_abs_price"),
        F.sum("delta_size").alias("delta_size"),
        F.sum("delta_abs_size").alias("delta_abs_size"),
    )


@query(
    "P12_plain_placeholders",
    """SELECT c_custkey, replace(c_name, '#', '*') || '*C' AS pattern FROM customer""",
)
def p12(spark, sf):
    c = table(spark, sf, "customer")
    marked = F.concat(F.replace("c_name", F.lit("#"), F.lit("[*:12]")), F.lit("[*:3]C"))
    return c.select("c_custkey", plain_placeholders(marked).alias("pattern"))


@query(
    "P13_case_study_gate",
    f"""WITH {SQL_CASE_PAIRS} SELECT source_index, only_left, only_right, round(sim, 6) AS sim FROM case_pairs
    WHERE sim BETWEEN 0.70 AND 0.90 AND n_left = 1 AND n_right = 1 AND length(only_left) BETWEEN 4 AND 20 AND length(only_right) BETWEEN 4 AND 20
      AND l_size <= 40 AND r_size <= 40""",
)
def p13(spark, sf):
    c = case_pairs(spark, sf)
    gated = P.case_study_gate(
        c.withColumns(
            {
                "only_left_count": F.col("n_left"),
                "only_right_count": F.col("n_right"),
                "only_left_size": F.length("only_left"),
                "only_right_size": F.length("only_right"),
            }
        ),
        F.col("sim"),
        caps={"l_size": 40, "r_size": 40},
    )
    return gated.select("source_index", "only_left", "only_right", F.round("sim", 6).alias("sim"))


@query(
    "P14_decode_check",
    f"""WITH {SQL_TURNS}, d AS (SELECT source_index, left_repr, right_repr, length(left_repr) % 4 <> 0 AS lk, length(right_repr) % 4 <> 0 AS rk,
        CASE WHEN length(left_repr) % 5 = 0 THEN lower(left_repr) ELSE left_repr END AS ld,
        CASE WHEN length(right_repr) % 5 = 0 THEN lower(right_repr) ELSE right_repr END AS rd FROM turns)
    SELECT source_index, lk AS left_decode_ok, rk AS right_decode_ok, lk AND ld = left_repr AS left_matches,
      rk AND rd = right_repr AS right_matches, lk AND ld = left_repr AND rk AND rd = right_repr AS decode_all_ok FROM d""",
)
def p14(spark, sf):
    """Code = the text itself; every fourth length fails to decode and every fifth decodes to lower case."""
    t = turns(spark, sf).withColumns({"left_code": F.col("left_repr"), "right_code": F.col("right_repr")})
    texts = t.select(F.explode(F.array("left_repr", "right_repr")).alias("code")).distinct()
    n = F.length("code")
    decoded = texts.select(
        "code", F.when(n % 4 != 0, F.when(n % 5 == 0, F.lower("code")).otherwise(F.col("code"))).alias("repr")
    )
    return P.decode_check(t, decoded).select(
        "source_index", "left_decode_ok", "right_decode_ok", "left_matches", "right_matches", "decode_all_ok"
    )


@query(
    "P15_same_skeleton",
    f"""WITH {SQL_TURNS} SELECT source_index FROM turns
    WHERE lower(string_split(left_repr, ' ')[1]) = lower(string_split(right_repr, ' ')[1])""",
)
def p15(spark, sf):
    t = turns(spark, sf).withColumns(
        {f"{s}_skeleton": F.lower(F.split(f"{s}_repr", " ")[0]) for s in ("left", "right")}
    )
    return P.same_skeleton(t).select("source_index")
