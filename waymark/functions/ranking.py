"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.tables import materialize


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its 0-based place in ``order``, which must be a total order.

    Rows are sorted by ranges over all tasks and written once; the place is
    the row's place in its range and the number of rows in the ranges before,
    one number a range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid, part, offset = (unused(c, [*df.columns, name]) for c in ("mid", "part", "offset"))
    # a hash of the whole order would lose it; ranges of an unequal size only cost balance
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn(part, F.shiftright(mid, 33)), "ranged")
    counts = sorted(ranged.groupBy(part).count().collect())  # a row for each range
    offsets, total = [], 0
    for p, count in counts:
        offsets.append((p, total))
        total += count
    table = spark.createDataFrame(offsets or [(0, 0)], f"`{part}` long, `{offset}` long")
    place = F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(table), part, "left").withColumn(name, F.col(offset) + place).drop(mid, part, offset)
