"""Readers for the raw layouts, record files and summary trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.schema import LABEL_CANDIDATES, REPR_CANDIDATES, require_columns


def load(
    spark: SparkSession, path: str, format: str = "auto", schema: str | None = None, quoted_lines: bool = True
) -> DataFrame:
    """CSV, TSV or Parquet by extension (a glob or folder keeps its last extension).

    With ``quoted_lines`` a quoted field may hold line breaks; such a text file is read by one task, so
    large inputs should be Parquet, or be read without it.
    """
    kind = format
    if kind == "auto":
        ext = path.rstrip("/*").rsplit(".", 1)[-1].lower()
        kind = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "txt": "tsv", "parquet": "parquet"}.get(ext)
        if kind is None:
            raise ValueError(f"cannot tell the format of {path}; pass format=")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind in ("csv", "tsv"):
        return (
            reader.option("header", True)
            .option("sep", "\t" if kind == "tsv" else ",")
            .option("multiLine", quoted_lines)
            .csv(path)
        )
    raise ValueError(f"unknown format {kind}")


#: Extensions taken off a dataset's name (fixed values).
EXTENSIONS = ("csv", "tsv", "tab", "txt", "parquet", "json", "jsonl")


def file_stem(path: Column) -> Column:
    """Name of the dataset a file belongs to, with one known extension taken off.

    A path that comes percent-encoded is decoded; a part file belongs to its folder.
    """
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    own = F.regexp_replace(plain, r"/(?:part-[^/]*|[^/]+=[^/]+)(?:/(?:part-[^/]*|[^/]+=[^/]+))*$", "")
    return F.regexp_replace(F.regexp_extract(own, "([^/]+)/*$", 1), rf"(?i)\.(?:{'|'.join(EXTENSIONS)})$", "")


def load_directory(
    spark: SparkSession,
    paths: Sequence[str],
    format: str,
    schema: str,
    excluded: Sequence[str] = (),
    quoted_lines: bool = True,
) -> DataFrame:
    """Raw files as one table: ``dataset_name`` is the file stem, ``endpoint`` the Task or the stem.

    A CSV whose quoted fields hold line breaks is read by one task a file; without ``quoted_lines`` such fields
    are not expected and large files are split.
    """
    reader = spark.read.schema(schema)
    if format == "parquet":
        raw = reader.parquet(*paths)
    else:
        raw = reader.option("header", True).option("sep", "\t" if format == "tsv" else ",").option("multiLine", quoted_lines).csv(list(paths))
    stem = file_stem(F.col("_metadata.file_path"))
    named = raw.withColumn("dataset_name", stem).filter(~F.col("dataset_name").isin(list(excluded)))
    endpoint = F.coalesce("Task", "dataset_name") if "Task" in raw.columns else F.col("dataset_name")
    return named.withColumn("endpoint", endpoint)


def pick_column(df: DataFrame, candidates: Sequence[str], name: str) -> DataFrame:
    """Rename the first candidate column that exists to ``name``."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, name)
    raise ValueError(f"none of {', '.join(candidates)} found")


def with_standard_names(df: DataFrame) -> DataFrame:
    return pick_column(pick_column(df, REPR_CANDIDATES, "repr"), LABEL_CANDIDATES, "label")


def binary_label(raw: Column) -> Column:
    """0 / 1 from numbers or words; anything else NULL."""
    text = F.lower(F.trim(raw.cast("string")))
    number = text.try_cast("double")
    # accepted spellings (fixed values)
    yes = ["1", "true", "yes", "y"]
    no = ["0", "false", "no", "n"]
    return (
        F.when(text.isin(yes) | (number == 1.0), 1)
        .when(text.isin(no) | (number == 0.0), 0)
        .cast("int")
    )


def _drop_corrupt(df: DataFrame, bad: Column) -> DataFrame:
    # a scan may not read the corrupt-record column alone, so the test touches a data column too
    touched = F.coalesce(F.length(F.col(df.columns[0]).cast("string")), F.lit(0)) >= 0
    return df.filter(~bad & touched).drop("_corrupt_record")


def load_tolerant_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV where lines with too many fields are skipped; missing fields at the end are NULL."""
    df = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("header", header)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)  # a line is judged by all its fields, whatever is selected
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )
    unquoted = F.regexp_replace("_corrupt_record", '"[^"]*"', "")
    n_fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    return _drop_corrupt(df, F.coalesce(n_fields > len(df.columns) - 1, F.lit(False)))


def clean_keyed(df: DataFrame, key: str, numeric: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with a key, first row per key by ``order``, numeric columns coerced with 0 for bad values."""
    require_columns(df, [key, *numeric, *order])
    d = df.filter(F.col(key).isNotNull())
    for c in numeric:
        d = d.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    rest = [c for c in d.columns if c != key]
    return (
        d.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(key, "_row.*")
    )


def load_records(spark: SparkSession, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank and broken lines are skipped."""
    df = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("ignoreMissingFiles", True)
        .json(paths)
    )
    return _drop_corrupt(df, F.col("_corrupt_record").isNotNull())


def path_fields(df: DataFrame, path: Column) -> DataFrame:
    """task / repre / step / model from ``task/…/repre/step/results/predictions_<model>.jsonl``.

    Paths are relative to the run folder. Without the two folders in front of ``results`` (the
    sub-task layout) representation and step are empty.
    """
    parts = F.split(path, "/")
    at = F.array_position(parts, F.lit("results")).cast("int")  # 1-based, 0 if absent
    deep = (at >= 5) & ~F.element_at(parts, 1).isin("subtask1", "subtask2")
    return df.withColumns(
        {
            "task": F.when(at >= 2, F.element_at(parts, 1)).otherwise(""),
            "repre": F.when(deep, F.try_element_at(parts, F.greatest(at - 2, F.lit(1)))).otherwise(""),
            "step": F.when(deep, F.try_element_at(parts, F.greatest(at - 1, F.lit(1)))).otherwise(""),
            "model": F.regexp_extract(path, r"results/predictions_(.+)\.jsonl$", 1),
        }
    ).filter(F.col("model") != "")


def run_numbers(df: DataFrame, name: Column) -> DataFrame:
    """``run`` and ``shots`` from file names such as ``…_run2_…`` and ``…_icl4``; 0 where absent."""
    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("int"), F.lit(0))

    return df.withColumn("run", number(r"run(\d+)")).withColumn("shots", number(r"icl(\d+)"))


def load_summaries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """A tree of summary JSON files as one flat table with run and shot numbers from the name."""
    df = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    return run_numbers(df, file_stem(F.col("source_file")))
