"""Pairs of neighbouring parts with feature maps, centres and bonds taken from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.plans.registry import table


def part_entities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size, brand = F.col("p_size"), F.substring("p_brand", 7, 9).cast("int")
    names = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    again = F.when(size % 4 == 0, F.concat(names, F.slice(names, 1, 1))).otherwise(names)
    words = F.when(size % 10 == 0, F.slice(again, 1, 0)).otherwise(again)
    kinds = F.array_distinct("words")
    positions = F.transform(
        kinds,
        lambda w: F.struct(
            w.alias("key"),
            F.transform(
                F.filter(
                    F.transform("words", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda e: e["w"] == w
                ),
                lambda e: F.array(e["i"].cast("int")),
            ).alias("value"),
        ),
    )
    side = F.when(size % 2 == 1, "R").otherwise("S")
    second = F.when(brand % 2 == 1, "R").otherwise("S")
    centres = F.filter(
        F.array(
            F.when(size % 5 != 0, F.struct(F.lit(0).alias("atom_idx"), side.alias("config"))),
            F.when(brand % 3 != 0, F.struct(F.lit(1).alias("atom_idx"), second.alias("config"))),
        ),
        lambda x: x.isNotNull(),
    )
    bond = F.when(size % 2 == 1, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    geometry = F.when(size % 3 == 0, "E").otherwise("Z")
    bonds = F.filter(
        F.array(F.when(size % 4 < 2, F.struct(bond.alias("bond"), geometry.alias("geometry")))),
        lambda x: x.isNotNull(),
    )
    return p.select("p_partkey", "p_name", "p_type", "p_brand", "p_size", words.alias("words")).select(
        "p_partkey",
        "p_name",
        "p_type",
        "p_brand",
        "p_size",
        "words",
        F.map_from_entries(positions).alias("fg_full"),
        centres.alias("chiral_centers"),
        bonds.alias("ez_bonds"),
    )


def part_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = part_entities(spark, sf)
    cols = ("p_name", "p_type", "p_brand", "p_size", "words", "fg_full", "chiral_centers", "ez_bonds")
    left = e.filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("pair_id"), *[F.col(c).alias(f"left_{c}") for c in cols]
    )
    right = e.filter("p_partkey % 2 = 1").select(
        (F.col("p_partkey") - 1).alias("pair_id"), *[F.col(c).alias(f"right_{c}") for c in cols]
    )
    return left.join(right, "pair_id").withColumns(
        {"dataset_name": F.col("left_p_type"), "endpoint": F.col("left_p_brand")}
    )


SQL_PART_PAIRS = """part_base AS (
  SELECT p_partkey, p_name, p_type, p_brand, p_size, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no,
         list_append(string_split(p_name, ' '), lower(p_type)) AS ws FROM part),
part_entities AS (
  SELECT p_partkey, p_name, p_type, p_brand, p_size,
    CASE WHEN p_size % 10 = 0 THEN [] WHEN p_size % 4 = 0 THEN list_append(ws, ws[1]) ELSE ws END AS words,
    list_filter([CASE WHEN p_size % 5 <> 0 THEN {'atom_idx': 0, 'config': CASE WHEN p_size % 2 = 1 THEN 'R' ELSE 'S' END} END,
                 CASE WHEN brand_no % 3 <> 0 THEN {'atom_idx': 1, 'config': CASE WHEN brand_no % 2 = 1 THEN 'R' ELSE 'S' END} END],
                lambda x: x IS NOT NULL) AS cc,
    list_filter([CASE WHEN p_size % 4 < 2 THEN {'bond': CASE WHEN p_size % 2 = 1 THEN [2, 1] ELSE [1, 2] END,
                 'geometry': CASE WHEN p_size % 3 = 0 THEN 'E' ELSE 'Z' END} END], lambda x: x IS NOT NULL) AS bb
  FROM part_base),
part_pairs AS (
  SELECT a.p_partkey AS pair_id, a.p_type AS dataset_name, a.p_brand AS endpoint, a.p_name AS l_name, b.p_name AS r_name,
    a.p_type AS l_type, b.p_type AS r_type, a.p_size AS l_size, b.p_size AS r_size, a.words AS l_words, b.words AS r_words,
    CASE WHEN len(b.words) = 0 THEN [] ELSE list_distinct(a.words) END AS l_names,
    CASE WHEN len(a.words) = 0 THEN [] ELSE list_distinct(b.words) END AS r_names,
    list_distinct(a.words) AS l_all, list_distinct(b.words) AS r_all,
    a.cc AS l_c, b.cc AS r_c, a.bb AS l_b, b.bb AS r_b
  FROM part_entities a JOIN part_entities b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 2 = 0)"""


def case_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Part pairs as cases: letters as features, words of the name as fragments."""
    p = part_pairs(spark, sf)
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: F.trim(x) != ""))
    d = p.select(
        F.col("pair_id").alias("source_index"),
        letters("left_p_name").alias("x"),
        letters("right_p_name").alias("y"),
        F.split("left_p_name", " ").alias("lw"),
        F.split("right_p_name", " ").alias("rw"),
        F.col("left_p_size").alias("l_size"),
        F.col("right_p_size").alias("r_size"),
    )
    common = F.size(F.array_intersect("x", "y"))
    d = d.withColumns({"n_x": F.size("x"), "n_y": F.size("y"), "n_common": common})
    left, right = F.array_except("lw", "rw"), F.array_except("rw", "lw")
    return d.select(
        "source_index", "n_x", "n_y", "n_common", "l_size", "r_size",
        (F.col("n_common") / (F.col("n_x") + F.col("n_y") - F.col("n_common"))).alias("sim"),
        F.array_join(left, ".").alias("only_left"),
        F.array_join(right, ".").alias("only_right"),
        F.size(left).alias("n_left"),
        F.size(right).alias("n_right"),
    )


SQL_CASE_PAIRS = f"""{SQL_PART_PAIRS}, letters AS (SELECT pair_id AS source_index, l_size, r_size,
    list_distinct(list_filter(string_split(l_name, ''), lambda c: trim(c) <> '')) AS x, list_distinct(list_filter(string_split(r_name, ''), lambda c: trim(c) <> '')) AS y,
    string_split(l_name, ' ') AS lw, string_split(r_name, ' ') AS rw FROM part_pairs),
common AS (SELECT *, len(list_intersect(x, y)) AS n_common, list_distinct(list_filter(lw, lambda w: NOT list_contains(rw, w))) AS ol,
    list_distinct(list_filter(rw, lambda w: NOT list_contains(lw, w))) AS orr FROM letters),
case_pairs AS (SELECT source_index, l_size, r_size, x, y, n_common, n_common / (len(x) + len(y) - n_common) AS sim,
    array_to_string(ol, '.') AS only_left, array_to_string(orr, '.') AS only_right, len(ol) AS n_left, len(orr) AS n_right FROM common)"""
