"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the full hash.

1. Lengths: texts are counted by their length in bytes; only lengths that occur twice go on.
2. Prefixes: texts of such lengths are counted by (length, hash of the first ``prefix`` characters); only
   pairs that occur twice go on.
3. Full hash: of the texts left, and of no other, the whole content is read and hashed (SHA-256), and rows
   are grouped by length, prefix hash and full hash.

Every level is a count with map-side aggregation, so a group of any size costs each task one row. The level
tables are broadcast only when counted to be small; beyond that they are joined through the grid join, which
deals a hot key over many tasks, and the texts that survived the level before travel once. Rows get their
group by the same join on narrow columns. No text is sent to be compared.

Defined results. A NULL text is an empty one and empty texts equal each other. Of a group the row with the
largest id stays; NULL ids come last, and of several rows with that id (repeated rows) exactly one stays. A group of
NULL ids has keep_id NULL. An empty table gives an empty result. Further columns of the input, whatever
their names, are neither read nor returned by ``exact_groups``; ``deduplicated`` returns them untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import staged
from pairloom.operators.skew import BROADCAST_KEYS, grid_join
from pairloom.session import cut

PREFIX = 64  # characters of a text that the second level hashes


def _repeated(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """The key values that occur more than once."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return cut(twice.select(*keys, F.lit(True).alias(flag)))


def _attached(df: DataFrame, extra: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Left join of a table with one row a key: broadcast if counted to be small, else dealt as a grid."""
    if extra.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(extra), keys, "left")
    return grid_join(df, extra, keys, salt, F.lit(0), how="left")


def refined(
    docs: DataFrame, id_col: str, text_col: str, prefix: int, digest: bool, row: Column | None = None
) -> DataFrame:
    """doc_id, row, len, head, full (NULL where an earlier level already told the text apart) and digest, written once."""
    t = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *([] if row is None else [row.alias("row")]),
    ).withColumn("len", F.octet_length("text"))
    salt = F.coalesce("doc_id", F.xxhash64(F.substring("text", -64, 64)))
    sized = _attached(t, _repeated(t, ["len"], "_sized"), ["len"], salt)
    head = F.when(F.col("_sized"), F.xxhash64(F.substring("text", 1, prefix)))
    headed = sized.withColumn("head", head).drop("_sized")
    shared = _repeated(headed.filter("head IS NOT NULL"), ["len", "head"], "_headed")
    headed = _attached(headed, shared, ["len", "head"], salt)
    # the digest column is asked for every row by its reader; the refinement itself hashes what is left only
    full = F.sha2("text", 256)
    return staged(
        headed.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row") if row is None else F.col("row"),
            "len",
            "head",
            F.when(F.col("_headed"), full).alias("full"),
            full.alias("digest") if digest else F.lit(None).cast("string").alias("digest"),
        )
    )


def _grouped(rows: DataFrame) -> DataFrame:
    keys = ["len", "head", "full"]
    groups = (
        rows.filter("full IS NOT NULL")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("doc_id", "row")).alias("_best"))
        .filter("_n > 1")
    )
    out = _attached(rows, cut(groups), keys, F.col("row"))
    alone = F.col("_n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("_best.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "row",
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = True
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and (with ``digest``) text_sha256: one row per input row."""
    out = _grouped(refined(docs, id_col, text_col, prefix, digest)).drop("row")
    return out if digest else out.drop("text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    numbered = staged(docs.withColumn(name, F.monotonically_increasing_id()))
    gone = _grouped(refined(numbered, id_col, text_col, prefix, False, F.col(name))).filter("NOT kept")
    return numbered.join(gone.select(F.col("row").alias(name)), name, "left_anti").select(*docs.columns)
