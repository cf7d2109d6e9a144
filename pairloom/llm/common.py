"""Helpers shared by the operators: staged tables, id and text columns, partition counts."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import ensure_checkpoint_dir, shuffle_width

BATCH_ROWS = 1_000  # rows of an Arrow batch: whole texts, which the JVM and the Python worker hold several times over
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
JOINED_BYTES = 8_000_000  # batches of narrow rows are put together up to this
WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run without ASCII white space


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines lack it there, the package is submitted with ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def short_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_ROWS`` rows at a time to Python, if it does not ask for fewer already."""
    now = int(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and go on from the written table.

    Used where a table is dear and read more than once; it survives lost executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, a NULL text as the empty one."""
    importable(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


_kept: dict[str, Any] = {}
_asked: set[str] = set()


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What this worker process keeps from task to task; the first task of ``map_rows`` that does not ask for it drops it."""
    _asked.add(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def begun(make: Callable[[], Any]) -> Any:
    """A task's state; what earlier tasks kept and this one does not ask for goes."""
    _asked.clear()
    out = make()
    for name in _kept.keys() - _asked:
        del _kept[name]
    return out


def give_back() -> None:
    """Hand unused buffers, Arrow's and those of the C library (where it is glibc), back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def joined(batches: Iterator[pa.RecordBatch], rows: int, most: int = JOINED_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``rows`` rows or ``most`` bytes: work on many narrow rows at once is cheaper."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= most:
            yield pa.concat_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    rows: int | None = None,
) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds a task's state once and returns its batch function.

    With ``rows`` the batches are put together until they hold so many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begun(make)
        for batch in batches if rows is None else joined(batches, rows):
            out = each(batch)
            if out is not None:
                yield out
        del each  # a worker goes on with other tasks: its state and unused buffers go back first
        give_back()

    importable(df.sparkSession)
    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key_crc(col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (NULL id: of the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def width(spark: SparkSession, least: int = 1) -> int:
    return max(least, shuffle_width(spark))
