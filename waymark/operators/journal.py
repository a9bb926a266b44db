"""Journal events in batch: changes of location, lookups with a fallback, imported routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geometry import to_scene
from waymark.functions.ranking import unused


def locations(jumps: DataFrame) -> DataFrame:
    """Jumps with their place in the scene's frame (doubles)."""
    pos = [F.get("StarPos", F.lit(i)) for i in range(3)]
    return jumps.withColumns({"x": -(pos[0] / 1000), "y": pos[1] / 1000, "z": pos[2] / 1000})


def changes(events: DataFrame, by: list[str], order: list[str], system: str) -> DataFrame:
    """Events whose system differs from that of the event before (of the same key)."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = unused("before", events.columns)
    return events.withColumn(before, F.lag(system).over(w)).where(~F.col(system).eqNullSafe(F.col(before))).drop(before)


def last_jump(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last event of each key, without a window."""
    cols = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("e")).select(*by, "e.*")


def lookup(wanted: DataFrame, local: DataFrame, external: DataFrame) -> DataFrame:
    """(name, x, y, z, source): the local catalog first, then the external one (raw light-years), null if neither has the name.

    Of rows that share a name in a catalog the last in order of ``pos`` holds.
    """
    ext = external.groupBy("name").agg(F.max_by(F.struct("x", "y", "z"), "pos").alias("e"))
    ext = ext.select("name", F.struct(*to_scene(F.col("e.x"), F.col("e.y"), F.col("e.z"))).alias("e"))
    loc = local.groupBy("name").agg(F.max_by(F.struct("x", "y", "z"), "pos").alias("l"))
    both = wanted.join(loc, "name", "left").join(ext, "name", "left")
    pick = F.coalesce("l", "e")
    return both.select("name", *[pick[c].alias(c) for c in "xyz"], F.when(F.col("l").isNotNull(), "local").when(F.col("e").isNotNull(), "external").alias("source"))


def resolve_import(rows: DataFrame, by_name: DataFrame, by_id: DataFrame, strict: bool = False) -> DataFrame:
    """Imported rows with coordinates by name, else by id64; ``strict`` fails on a row that has neither.  Of rows that share a name or an id the one with the least coordinates holds."""
    n = by_name.groupBy("name").agg(F.min(F.struct("x", "y", "z")).alias("n"))
    i = by_id.groupBy("id64").agg(F.min(F.struct("x", "y", "z")).alias("i"))
    c = F.coalesce("n", "i")
    out = rows.join(n, "name", "left").join(i, "id64", "left").select(*rows.columns, *[c[a].alias(a) for a in "xyz"])
    if strict:
        out = out.withColumn("x", F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("no coordinates for "), F.col("name")))).otherwise(F.col("x")))
    return out
