"""Row-level differences of the part pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import rowdiff as D
from pairloom.operators.filters import pair_step, pair_type
from pairloom.plans.part_pairs import part_pairs
from pairloom.plans.q_joins import SQL_STEREO
from pairloom.plans.registry import query

_DIFF = "list_filter({a}, lambda x: NOT list_contains({b}, x))"
SQL_DIFF = f"""{SQL_STEREO}, df AS (SELECT *, {_DIFF.format(a='l_c', b='r_c')} AS lc_only, {_DIFF.format(a='r_c', b='l_c')} AS rc_only,
  {_DIFF.format(a='l_b', b='r_b')} AS lb_only, {_DIFF.format(a='r_b', b='l_b')} AS rb_only,
  len({_DIFF.format(a='l_c', b='r_c')}) + len(list_filter(r_c, lambda x: NOT list_contains(list_transform(l_c, lambda y: y.atom_idx), x.atom_idx))) AS n_c,
  list_transform(l_b, lambda x: {{'k': array_to_string(list_sort(x.bond), '-'), 'v': x.geometry}}) AS l_kb,
  list_transform(r_b, lambda x: {{'k': array_to_string(list_sort(x.bond), '-'), 'v': x.geometry}}) AS r_kb,
  list_sort(l_all) = list_sort(r_all) AS same_names,
  list_sort(list_filter(l_all, lambda x: list_contains(r_all, x) AND list_filter(range(len(l_words)), lambda i: l_words[i + 1] = x) <> list_filter(range(len(r_words)), lambda i: r_words[i + 1] = x))) AS moved
  FROM st),
counts AS (SELECT *, len({_DIFF.format(a='l_kb', b='r_kb')}) + len(list_filter(r_kb, lambda x: NOT list_contains(list_transform(l_kb, lambda y: y.k), x.k))) AS n_b FROM df),
typed AS (SELECT *, CAST(n_fg AS INTEGER) AS n_fg_diff, CAST(n_c + n_b AS INTEGER) AS n_stereo_diff, CAST(n_fg + n_c + n_b AS INTEGER) AS n_diff_features,
  CASE WHEN n_fg > 0 AND n_c + n_b > 0 THEN 'both' WHEN n_fg > 0 THEN 'only_fg' WHEN n_c + n_b > 0 THEN 'only_stereo' ELSE 'none' END AS diff_type,
  CASE WHEN n_fg + n_c + n_b = 1 THEN 'one_step' ELSE 'multi_step' END AS step_num FROM counts)"""


@query(
    "D1_strict_stereo",
    f"WITH {SQL_STEREO} SELECT pair_id, c_strict AS chiral_diff, b_strict AS ez_diff, CASE WHEN c_strict AND b_strict THEN 'both' WHEN c_strict THEN 'chiral_only' WHEN b_strict THEN 'ez_only' ELSE '' END AS stereo_diff_type FROM st",
)
def d1(spark, sf):
    return D.strict_stereo_diff(part_pairs(spark, sf)).select("pair_id", "chiral_diff", "ez_diff", "stereo_diff_type")


@query(
    "D2_loose_stereo",
    f"WITH {SQL_STEREO} SELECT pair_id, CASE WHEN c_loose AND b_loose THEN 'both' WHEN c_loose THEN 'chiral_only' WHEN b_loose THEN 'ez_only' ELSE '' END AS stereo_diff_type_loose, c_loose::INTEGER + b_loose::INTEGER AS n_stereo_diff FROM st",
)
def d2(spark, sf):
    return D.loose_stereo_diff(part_pairs(spark, sf)).select("pair_id", "stereo_diff_type_loose", "n_stereo_diff")


@query("D3_element_counts", f"WITH {SQL_DIFF} SELECT pair_id, CAST(n_c AS INTEGER) AS n_chiral_diff, CAST(n_b AS INTEGER) AS n_ez_diff FROM counts")
def d3(spark, sf):
    return D.element_diff_counts(part_pairs(spark, sf)).select("pair_id", "n_chiral_diff", "n_ez_diff")


@query("D4_diff_features", f"WITH {SQL_DIFF} SELECT pair_id, n_fg_diff, n_stereo_diff, n_diff_features, n_fg_diff + c_loose::INTEGER + b_loose::INTEGER AS by_kind FROM typed")
def d4(spark, sf):
    p = part_pairs(spark, sf)
    a = D.diff_features(p).select("pair_id", "n_fg_diff", "n_stereo_diff", "n_diff_features")
    b = D.diff_features(p, by_element=False).select("pair_id", F.col("n_diff_features").alias("by_kind"))
    return a.join(b, "pair_id")


@query("D5_position_diff", f"WITH {SQL_DIFF} SELECT pair_id, CASE WHEN same_names THEN array_to_string(moved, ',') ELSE '' END AS moved FROM df")
def d5(spark, sf):
    return part_pairs(spark, sf).select("pair_id", F.array_join(D.position_changed_names(), ",").alias("moved"))


@query(
    "D6_name_sets",
    f"""WITH {SQL_DIFF} SELECT pair_id, array_to_string(list_sort({_DIFF.format(a='l_all', b='r_all')}), ',') AS only_left, array_to_string(list_sort({_DIFF.format(a='r_all', b='l_all')}), ',') AS only_right,
      array_to_string(list_sort(list_filter(l_all, lambda x: list_contains(r_all, x))), ',') AS common FROM df""",
)
def d6(spark, sf):
    common = F.sort_array(F.array_intersect(F.map_keys("left_fg_full"), F.map_keys("right_fg_full")))
    return part_pairs(spark, sf).select(
        "pair_id",
        F.array_join(D.names_on_one_side("left", "right"), ",").alias("only_left"),
        F.array_join(D.names_on_one_side("right", "left"), ",").alias("only_right"),
        F.array_join(common, ",").alias("common"),
    )


SQL_ISOMER = f"""{SQL_DIFF}, iso AS (SELECT *, len(l_c) = len(r_c) AND len(l_c) > 0 AND l_type = r_type
    AND len(list_filter(l_c, lambda x: x.config = 'R')) = len(list_filter(r_c, lambda x: x.config = 'S')) AND len(list_filter(l_c, lambda x: x.config = 'S')) = len(list_filter(r_c, lambda x: x.config = 'R')) AS is_mirror,
    len(l_b) > 0 AND len(r_b) > 0 AND b_loose AS is_ez, NOT same_names AS is_fg, same_names AND len(moved) > 0 AS is_position FROM df),
iso2 AS (SELECT *, NOT is_mirror AND len(l_c) > 0 AND len(r_c) > 0 AS is_diastereo FROM iso),
iso3 AS (SELECT *, CASE WHEN is_mirror THEN 'Enantiomer' WHEN is_diastereo THEN 'Diastereomer' WHEN is_ez THEN 'E/Z Isomer' END AS stereo_name,
  CASE WHEN is_fg THEN 'Functional Group Isomer' WHEN is_position THEN 'Position Isomer' END AS struct_name FROM iso2)"""


def _same_type():
    return F.col("left_p_type") == F.col("right_p_type")


@query("D7_mirror", f"WITH {SQL_ISOMER} SELECT pair_id, is_mirror FROM iso")
def d7(spark, sf):
    return part_pairs(spark, sf).select("pair_id", D.is_mirror(_same_type()).alias("is_mirror"))


@query("D8_diastereo_and_ez", f"WITH {SQL_ISOMER} SELECT pair_id, is_diastereo, is_ez FROM iso2")
def d8(spark, sf):
    return part_pairs(spark, sf).select(
        "pair_id", D.is_diastereo(D.is_mirror(_same_type())).alias("is_diastereo"), D.is_ez().alias("is_ez")
    )


@query("D9_primary_type", f"WITH {SQL_ISOMER} SELECT pair_id, coalesce(struct_name || ' + ' || stereo_name, stereo_name, struct_name, 'Unknown') AS primary_type FROM iso3 WHERE stereo_name IS NOT NULL")
def d9(spark, sf):
    d = D.classify_isomers(part_pairs(spark, sf), _same_type())
    return d.filter("is_mirror OR is_diastereo OR is_ez").select("pair_id", "primary_type")


_CENTRE = "lambda x: 'centre ' || x.atom_idx || '=' || x.config"
_BOND = "lambda x: 'bond ' || array_to_string(x.bond, '-') || '=' || x.geometry"


def sql_elements(side):
    """Texts of what one side (l or r) has and the other lacks or has otherwise."""
    return f"list_concat(list_transform({side}c_only, {_CENTRE}), list_transform({side}b_only, {_BOND}))"


def sql_unique(side):
    own = sql_elements(side)
    return f"CASE WHEN len({own}) = 0 AND (len(l_c) <> len(r_c) OR len(l_b) <> len(r_b)) THEN ['fewer elements'] ELSE {own} END"


@query(
    "D10_unique_stereo",
    f"WITH {SQL_DIFF} SELECT pair_id, array_to_string({sql_unique('l')}, '; ') AS left_unique, array_to_string({sql_unique('r')}, '; ') AS right_unique FROM df",
)
def d10(spark, sf):
    return part_pairs(spark, sf).select(
        "pair_id",
        F.array_join(D.unique_stereo("left", "right"), "; ").alias("left_unique"),
        F.array_join(D.unique_stereo("right", "left"), "; ").alias("right_unique"),
    )


SQL_PLAN_TEXT = f"""CASE WHEN len(l_c) + len(r_c) + len(l_b) + len(r_b) = 0 THEN '(nothing to compare)' WHEN len({sql_elements('l')}) + len({sql_elements('r')}) = 0 THEN '(no edits)'
  ELSE array_to_string(list_concat(list_transform({sql_elements('l')}, lambda t: '-' || t), list_transform({sql_elements('r')}, lambda t: '+' || t)), chr(10)) END"""
SQL_PLAN = f"{SQL_DIFF}, plan AS (SELECT pair_id, {SQL_PLAN_TEXT} AS plan FROM df)"


@query("D11_plan_text", f"WITH {SQL_PLAN} SELECT pair_id, plan FROM plan")
def d11(spark, sf):
    return part_pairs(spark, sf).select("pair_id", D.plan_text().alias("plan"))


def typed_pairs(spark, sf):
    d = D.diff_features(part_pairs(spark, sf))
    return d.withColumns(
        {
            "diff_type": pair_type(F.col("n_fg_diff"), F.col("n_stereo_diff")),
            "step_num": pair_step(F.col("n_diff_features")),
        }
    )


@query(
    "D12_export_tables",
    f"""WITH {SQL_DIFF} SELECT diff_type, step_num, pair_id, CASE WHEN diff_type IN ('only_fg', 'both') THEN CAST(len(list_filter(l_names, lambda x: NOT list_contains(r_names, x))) AS INTEGER) END AS n_left_names,
      CASE WHEN diff_type IN ('only_stereo', 'both') THEN CAST(len(lc_only) + len(lb_only) AS INTEGER) END AS n_left_stereo FROM typed WHERE diff_type <> 'none'""",
)
def d12(spark, sf):
    d = typed_pairs(spark, sf).filter("diff_type <> 'none'")
    fg = F.col("diff_type").isin("only_fg", "both")
    stereo = F.col("diff_type").isin("only_stereo", "both")
    left_names = F.size(F.filter("unique_fg", lambda u: u["reason"] == "left_only"))
    return d.select(
        "diff_type",
        "step_num",
        "pair_id",
        F.when(fg, left_names).alias("n_left_names"),
        F.when(stereo, F.size(D.changed_elements("left", "right"))).alias("n_left_stereo"),
    )


@query(
    "D13_feature_coverage",
    f"""WITH {SQL_DIFF}, r AS (SELECT pair_id, list_filter(range(len(l_words)), lambda i: list_contains(r_all, l_words[i + 1])) AS l_rest, list_filter(range(len(r_words)), lambda i: list_contains(l_all, r_words[i + 1])) AS r_rest FROM df)
    SELECT pair_id, array_to_string(l_rest, ',') AS left_rest, array_to_string(r_rest, ',') AS right_rest, len(l_rest) = len(r_rest) AS rest_equal FROM r""",
)
def d13(spark, sf):
    d = D.feature_coverage(part_pairs(spark, sf))
    return d.select(
        "pair_id",
        F.array_join(F.transform("left_rest", lambda x: x.cast("string")), ",").alias("left_rest"),
        F.array_join(F.transform("right_rest", lambda x: x.cast("string")), ",").alias("right_rest"),
        "rest_equal",
    )


SQL_SITES = "'[' || array_to_string(list_concat(list_transform(lc_only, lambda x: '{\"type\":\"' || x.config || '\",\"indices\":[' || x.atom_idx || ']}'), list_transform(lb_only, lambda x: '{\"type\":\"' || x.geometry || '\",\"indices\":[' || array_to_string(x.bond, ',') || ']}')), ',') || ']'"


@query("D14_site_list", f"WITH {SQL_DIFF} SELECT pair_id, {SQL_SITES} AS sites FROM df")
def d14(spark, sf):
    return part_pairs(spark, sf).select("pair_id", F.to_json(D.site_list()).alias("sites"))


@query(
    "D15_plan_records",
    f"""WITH {SQL_DIFF} SELECT pair_id, CAST(len(lc_only) + len(lb_only) AS INTEGER) AS n_removed,
      CAST(len(list_filter(lc_only, lambda x: list_contains(list_transform(r_c, lambda y: y.atom_idx), x.atom_idx))) + len(list_filter(lb_only, lambda x: list_contains(list_transform(r_b, lambda y: y.bond), x.bond))) AS INTEGER) AS n_added,
      array_to_string(list_transform(lc_only, lambda x: x.config), ',') AS removed_configs, 'centres ' || len(lc_only) || ', bonds ' || len(lb_only) AS strategy FROM df""",
)
def d15(spark, sf):
    d = D.plan_records(part_pairs(spark, sf))
    centres = F.filter("removed", lambda x: x["kind"] == "centre")
    return d.select(
        "pair_id",
        F.size("removed").alias("n_removed"),
        F.size("added").alias("n_added"),
        F.array_join(F.transform(centres, lambda x: x["value"]), ",").alias("removed_configs"),
        "strategy",
    )
