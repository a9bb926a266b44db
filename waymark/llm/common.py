"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources import tables
from waymark.sources.tables import fresh_path, remove, shared_dir

__all__ = ["fold", "fresh_path", "give_back", "materialize", "numbered_columns", "quoted", "remove", "shared_dir", "shuffle_partitions", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of one batch between the JVM and Python while a table is written; the JVM and two workers hold one each, and texts are long.
BATCH_ROWS = 4000


def materialize(df: DataFrame, tag: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write a table to the shared folder and read it back, Arrow batches of at most ``batch_rows`` rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        return tables.materialize(df, tag)
    finally:
        conf.set(key, before)


def fold(c: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... by place, so that no name of an operator's own can clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return what earlier tasks of this worker have left to the system; workers live on, and two of them share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)
