"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "pairloom") -> SparkSession:
    """A session for tests and benches; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("PAIRLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="spark-pairloom-", dir="/tmp")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """:func:`cut` for wide tables: written once as compressed Parquet, a fraction of a checkpoint's size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*steps: Callable[[], Any]) -> list[Any]:
    """Results of steps that do not need each other, run at once: one's last tasks leave no executor idle."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # tags are not inherited; local properties are
        targets = [inheritable_thread_target(step) for step in steps]
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(t) for t in targets]]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_slots(spark: SparkSession) -> int:
    """How many tasks run at once, as far as known (at most the shuffle partitions); at least 8 if those allow."""
    return min(shuffle_width(spark), max(spark.sparkContext.defaultParallelism, 8))
