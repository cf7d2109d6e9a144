"""Typed differences between the two sides of a pair: feature maps, centres and bonds.

Sides are ``left_…`` and ``right_…`` columns: ``fg_full`` map<name, positions>, ``chiral_centers``
array<struct<atom_idx, config>>, ``ez_bonds`` array<struct<bond, geometry>>. Everything is an
expression on one row; keys (atom index, bond) are unique within a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTRES, BONDS = "chiral_centers", "ez_bonds"


def _names(side: str) -> Column:
    return F.map_keys(F.coalesce(f"{side}_fg_full", F.create_map().cast("map<string,array<array<int>>>")))


def names_on_one_side(side: str, other: str) -> Column:
    return F.sort_array(F.array_except(_names(side), _names(other)))


def feature_name_diff(df: DataFrame) -> DataFrame:
    """``unique_fg``: names on one side only, with their positions; empty unless both sides have features."""
    both = (F.size(_names("left")) > 0) & (F.size(_names("right")) > 0)
    none = F.array().cast("array<array<int>>")

    def rows(side: str, other: str) -> Column:
        return F.transform(
            names_on_one_side(side, other),
            lambda n: F.struct(
                n.alias("fg_name"),
                F.lit(f"{side}_only").alias("reason"),
                (F.col("left_fg_full")[n] if side == "left" else none).alias("left_positions"),
                (F.col("right_fg_full")[n] if side == "right" else none).alias("right_positions"),
            ),
        )

    found = F.concat(rows("left", "right"), rows("right", "left"))
    d = df.withColumn("unique_fg", F.when(both, found).otherwise(F.slice(found, 1, 0)))
    return d.withColumn("n_fg_diff", F.size("unique_fg")).withColumn("has_fg_diff", F.col("n_fg_diff") > 0)


def _configs(side: str, column: str) -> Column:
    field = "config" if column == CENTRES else "geometry"
    return F.transform(f"{side}_{column}", lambda x: x[field])


def _count(side: str, column: str, value: str) -> Column:
    return F.size(F.filter(_configs(side, column), lambda x: x == value))


def stereo_label(centres: Column, bonds: Column) -> Column:
    return (
        F.when(centres & bonds, "both").when(centres, "chiral_only").when(bonds, "ez_only").otherwise("")
    )


def strict_stereo_diff(df: DataFrame) -> DataFrame:
    """Both sides carry the element and their sorted values differ."""
    def differs(column: str) -> Column:
        a, b = F.sort_array(_configs("left", column)), F.sort_array(_configs("right", column))
        return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)

    d = df.withColumn("chiral_diff", differs(CENTRES)).withColumn("ez_diff", differs(BONDS))
    return d.withColumn("stereo_diff_type", stereo_label(F.col("chiral_diff"), F.col("ez_diff")))


def loose_stereo_diff(df: DataFrame) -> DataFrame:
    """Number of elements, or number of any one value, differs; counts kinds (0 to 2)."""
    def differs(column: str, values: tuple[str, str]) -> Column:
        out = F.size(f"left_{column}") != F.size(f"right_{column}")
        for v in values:
            out = out | (_count("left", column, v) != _count("right", column, v))
        return out

    d = df.withColumn("chiral_diff_loose", differs(CENTRES, ("R", "S"))).withColumn(
        "ez_diff_loose", differs(BONDS, ("E", "Z"))
    )
    return d.withColumn(
        "stereo_diff_type_loose", stereo_label(F.col("chiral_diff_loose"), F.col("ez_diff_loose"))
    ).withColumn(
        "n_stereo_diff", F.col("chiral_diff_loose").cast("int") + F.col("ez_diff_loose").cast("int")
    )


def keyed_centres(side: str, known_only: bool = False) -> Column:
    """(key, value) pairs of centres; with ``known_only`` values are reduced to R or S, others dropped."""
    def entry(x: Column) -> Column:
        raw = x["config"]
        value = F.when(raw.contains("R"), "R").when(raw.contains("S"), "S") if known_only else F.upper(F.trim(raw))
        return F.struct(x["atom_idx"].cast("string").alias("key"), value.alias("value"))

    out = F.transform(f"{side}_{CENTRES}", entry)
    return F.filter(out, lambda x: x["value"].isNotNull())


def keyed_bonds(side: str) -> Column:
    """(key, value) pairs of bonds; the bond's ends are put in order."""
    return F.transform(
        f"{side}_{BONDS}",
        lambda x: F.struct(
            F.array_join(F.sort_array(x["bond"]), "-").alias("key"), F.upper(F.trim(x["geometry"])).alias("value")
        ),
    )


def n_keyed_differences(a: Column, b: Column) -> Column:
    """Keys of either side whose value is missing or different on the other."""
    changed = F.size(F.filter(a, lambda x: ~F.array_contains(b, x)))
    keys = F.transform(a, lambda x: x["key"])
    added = F.size(F.filter(b, lambda x: ~F.array_contains(keys, x["key"])))
    return changed + added


def element_diff_counts(df: DataFrame, known_only: bool = True) -> DataFrame:
    d = df.withColumns(
        {
            "n_chiral_diff": n_keyed_differences(
                keyed_centres("left", known_only), keyed_centres("right", known_only)
            ),
            "n_ez_diff": n_keyed_differences(keyed_bonds("left"), keyed_bonds("right")),
        }
    )
    return d.withColumn("n_stereo_elements", F.col("n_chiral_diff") + F.col("n_ez_diff"))


def diff_features(df: DataFrame, by_element: bool = True) -> DataFrame:
    """``n_fg_diff``, ``n_stereo_diff`` (elements, or kinds) and their sum."""
    d = feature_name_diff(df)
    if by_element:
        d = element_diff_counts(d).withColumn("n_stereo_diff", F.col("n_stereo_elements"))
    else:
        d = loose_stereo_diff(d)
    return d.withColumn("n_diff_features", F.col("n_fg_diff") + F.col("n_stereo_diff"))


def _position_set(side: str, name: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(F.col(f"{side}_fg_full")[name], lambda p: F.sort_array(p))))


def same_names() -> Column:
    return F.sort_array(_names("left")) == F.sort_array(_names("right"))


def position_changed_names() -> Column:
    """Shared names whose position sets differ, given that both sides have the same names."""
    moved = F.filter(
        F.sort_array(_names("left")), lambda n: _position_set("left", n) != _position_set("right", n)
    )
    return F.when(same_names(), moved).otherwise(F.slice(moved, 1, 0))


def is_mirror(skeleton: Column) -> Column:
    """All centres labelled, R and S counts swapped, at least one centre, same skeleton."""
    lr, ls = _count("left", CENTRES, "R"), _count("left", CENTRES, "S")
    rr, rs = _count("right", CENTRES, "R"), _count("right", CENTRES, "S")
    n = F.size(f"left_{CENTRES}")
    return (
        (n == F.size(f"right_{CENTRES}")) & (n > 0) & (lr == rs) & (ls == rr) & (lr + ls == n) & skeleton
    )


def is_diastereo(mirror: Column) -> Column:
    return ~mirror & (F.size(f"left_{CENTRES}") > 0) & (F.size(f"right_{CENTRES}") > 0)


def is_ez() -> Column:
    a, b = F.size(f"left_{BONDS}"), F.size(f"right_{BONDS}")
    changed = (_count("left", BONDS, "E") != _count("right", BONDS, "E")) | (
        _count("left", BONDS, "Z") != _count("right", BONDS, "Z")
    )
    return (a > 0) & (b > 0) & changed


def primary_type(position: Column, fg: Column, mirror: Column, diastereo: Column, ez: Column) -> Column:
    """One label from the five tests; a structural and a stereo label are joined with `` + ``."""
    # labels (fixed values)
    stereo = F.when(mirror, "Enantiomer").when(diastereo, "Diastereomer").when(ez, "E/Z Isomer")
    structural = F.when(fg, "Functional Group Isomer").when(position, "Position Isomer")
    return F.coalesce(F.concat(structural, F.lit(" + "), stereo), stereo, structural, F.lit("Unknown"))


def classify_isomers(df: DataFrame, skeleton: Column) -> DataFrame:
    d = df.withColumn("position_names", position_changed_names()).withColumns(
        {
            "is_position": F.size("position_names") > 0,
            "is_fg": ~same_names(),
            "is_mirror": is_mirror(skeleton),
            "is_ez": is_ez(),
        }
    )
    d = d.withColumn("is_diastereo", is_diastereo(F.col("is_mirror")))
    return d.withColumn(
        "primary_type",
        primary_type(*[F.col(c) for c in ("is_position", "is_fg", "is_mirror", "is_diastereo", "is_ez")]),
    )


# --- texts and records -------------------------------------------------------------------------


def _centres_changed(side: str, other: str) -> Column:
    o = F.col(f"{other}_{CENTRES}")
    return F.filter(f"{side}_{CENTRES}", lambda x: ~F.array_contains(o, x))


def _bonds_changed(side: str, other: str) -> Column:
    o = F.col(f"{other}_{BONDS}")
    return F.filter(f"{side}_{BONDS}", lambda x: ~F.array_contains(o, x))


def changed_elements(side: str, other: str) -> Column:
    """What one side has and the other lacks or has otherwise: ``array<struct<kind, key, value>>``."""
    def row(kind: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))

    centres = F.transform(_centres_changed(side, other), lambda x: row("centre", F.array(x["atom_idx"]), x["config"]))
    bonds = F.transform(_bonds_changed(side, other), lambda x: row("bond", x["bond"], x["geometry"]))
    return F.concat(centres, bonds)


def element_text(x: Column) -> Column:
    """``kind key=value`` with the key's numbers joined by dashes."""
    return F.concat(x["kind"], F.lit(" "), F.array_join(x["key"], "-"), F.lit("="), x["value"])


def unique_stereo(side: str, other: str) -> Column:
    """Texts of the changed elements of one side; where only the loose counts differ, one text that says so."""
    own = F.transform(changed_elements(side, other), element_text)
    loose = F.lit(False)
    for name in (CENTRES, BONDS):
        loose = loose | (F.size(f"{side}_{name}") != F.size(f"{other}_{name}"))
    return F.when((F.size(own) == 0) & loose, F.array(F.lit("fewer elements"))).otherwise(own)


def plan_text() -> Column:
    """The changed elements as an edit list: a line with ``-`` for the left side's, with ``+`` for the right side's."""
    def lines(sign: str, side: str, other: str) -> Column:
        return F.transform(changed_elements(side, other), lambda x: F.concat(F.lit(sign), element_text(x)))

    some = F.lit(0)
    for side in ("left", "right"):
        some = some + F.size(f"{side}_{CENTRES}") + F.size(f"{side}_{BONDS}")
    edits = F.concat(lines("-", "left", "right"), lines("+", "right", "left"))
    return F.when(some == 0, "(nothing to compare)").when(F.size(edits) == 0, "(no edits)").otherwise(F.array_join(edits, "\n"))


def site_list(side: str = "left", other: str = "right") -> Column:
    """``array<struct<type, indices>>`` of elements missing or different on the other side."""
    centres = F.transform(
        _centres_changed(side, other),
        lambda x: F.struct(
            F.when(x["config"].contains("R"), "R").when(x["config"].contains("S"), "S").otherwise(x["config"]).alias("type"),
            F.array(x["atom_idx"]).alias("indices"),
        ),
    )
    bonds = F.transform(
        _bonds_changed(side, other),
        lambda x: F.struct(x["geometry"].alias("type"), x["bond"].alias("indices")),
    )
    return F.concat(centres, bonds)


def plan_records(df: DataFrame) -> DataFrame:
    """``removed`` and ``added`` element records (kind, key, value) and their numbers per kind.

    ``added`` has the other side's value of a removed key, where it has that key.
    """
    removed = changed_elements("left", "right")
    theirs = F.concat(
        F.transform(f"right_{CENTRES}", lambda y: F.struct(F.lit("centre").alias("kind"), F.array(y["atom_idx"]).alias("key"), y["config"].alias("value"))),
        F.transform(f"right_{BONDS}", lambda y: F.struct(F.lit("bond").alias("kind"), y["bond"].alias("key"), y["geometry"].alias("value"))),
    )
    d = df.withColumn("removed", removed).withColumn("_theirs", theirs)
    added = F.flatten(
        F.transform("removed", lambda x: F.filter("_theirs", lambda y: (y["kind"] == x["kind"]) & (y["key"] == x["key"])))
    )
    number = lambda kind: F.size(F.filter("removed", lambda x: x["kind"] == kind)).cast("string")
    counts = F.concat(F.lit("centres "), number("centre"), F.lit(", bonds "), number("bond"))
    return d.withColumn("added", added).withColumn("strategy", counts).drop("_theirs")


def feature_coverage(df: DataFrame) -> DataFrame:
    """Positions of each side not explained by its one-sided names, and whether both leave the same count."""
    def rest(side: str, other: str) -> Column:
        every = F.flatten(F.flatten(F.map_values(f"{side}_fg_full")))
        own = F.flatten(
            F.flatten(F.transform(names_on_one_side(side, other), lambda n: F.col(f"{side}_fg_full")[n]))
        )
        return F.sort_array(F.array_except(every, own))

    d = df.withColumn("left_rest", rest("left", "right")).withColumn("right_rest", rest("right", "left"))
    return d.withColumn("rest_equal", F.size("left_rest") == F.size("right_rest"))
