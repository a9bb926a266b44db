"""Writers: the star and names tables, flat star arrays, stored values."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geometry import cell
from waymark.sources.tables import remove


def write_stars(stars: DataFrame, path: str, side: float, partitions: int) -> None:
    """Stars with their grid cells (cx, cy, cz), by ranges of these, sorted in each file, so that a box reads few row groups."""
    n = stars.withColumns(dict(zip(("cx", "cy", "cz"), cell("", side), strict=True)))
    n.repartitionByRange(partitions, "cx", "cy", "cz").sortWithinPartitions("cx", "cy", "cz").write.mode("overwrite").parquet(path)


def write_names(ranked: DataFrame, path: str, partitions: int) -> None:
    """The index of names by ranges of their folded form, for prefix filters that reach Parquet's statistics."""
    ranked.repartitionByRange(partitions, "fold").sortWithinPartitions("fold", "name").write.mode("overwrite").parquet(path)


def write_ids(stars: DataFrame, path: str, partitions: int) -> None:
    """Stars by ranges of their ids."""
    stars.repartitionByRange(partitions, "star_id").sortWithinPartitions("star_id").write.mode("overwrite").parquet(path)


def star_bytes(stars: DataFrame) -> Iterator[bytes]:
    """The flat array of a catalog, in order of star_id, some rows at a time."""
    held = []
    for r in stars.orderBy("star_id").select("x", "y", "z").toLocalIterator():
        held.append(struct.pack("<3f", r["x"], r["y"], r["z"]))
        if len(held) == 100_000:
            yield b"".join(held)
            held = []
    yield b"".join(held)


def write_star_array(stars: DataFrame, path: str) -> None:
    """The flat array as one file of any file system that Spark reads; one file has one writer, the driver, which holds a part of it at a time."""
    spark = stars.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for part in star_bytes(stars):
            out.write(bytearray(part))
    finally:
        out.close()


def flatten_coords(stars: DataFrame, by: str) -> DataFrame:
    """(by, coords): x, y, z of each row after one another, in order of star_id."""
    rows = F.sort_array(F.collect_list(F.struct("star_id", F.array("x", "y", "z").alias("c"))))
    return stars.groupBy(by).agg(F.flatten(F.transform(rows, lambda r: r["c"])).alias("coords"))


def unflatten_coords(flat: DataFrame, by: str) -> DataFrame:
    """The inverse: (by, seq, x, y, z); a rest of fewer than three numbers is dropped."""
    n = F.floor(F.size("coords") / 3).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    return flat.select(by, "coords", F.explode(at).alias("seq")).select(by, "seq", *[F.get("coords", F.col("seq") * 3 + i).alias(c) for i, c in enumerate("xyz")])


def store(value: DataFrame, path: str) -> None:
    value.write.mode("overwrite").json(path)


def clear(spark: SparkSession, path: str) -> None:
    """Take a stored value away; there need not be one."""
    remove(spark, path)
