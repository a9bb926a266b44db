"""Catalog build: fold nested bodies, filter, sample, deduplicate, scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geometry import to_scene
from waymark.functions.ranking import with_row_index

NEUTRON = "Neutron Star"
#: First letters of sub types that refuel ("Black Hole" counts by its B).
SCOOPABLE = list("KGBFOAM")
#: Light-years from a neutron star's system centre, of a slab of the dead zone, and how many dead-zone rows there are to one that is kept.
NEAR, SLAB, EVERY = 3000.0, 800.0, 256


def fold_bodies(raw: DataFrame) -> DataFrame:
    """``raw`` with main_is_neutron, refuelable (of the last main star), nearby_neutron and has_population instead of bodies."""
    bodies = F.coalesce("bodies", F.expr("array()").cast(raw.schema["bodies"].dataType))
    main = F.element_at(F.filter(bodies, lambda b: F.coalesce(b["mainStar"], F.lit(False))), -1)
    last = F.when(F.exists(bodies, lambda b: F.coalesce(b["mainStar"], F.lit(False))), main)["subType"]
    near = F.exists(bodies, lambda b: (F.coalesce(b["subType"], F.lit("")) == NEUTRON) & (F.coalesce(b["distanceToArrival"], F.lit(0.0)) <= NEAR))
    people = F.exists(bodies, lambda b: F.coalesce(b["population"], F.lit(0)) > 0)
    return raw.withColumns(
        {
            "main_is_neutron": F.coalesce(last == NEUTRON, F.lit(False)),
            "refuelable": F.coalesce(F.substring(last, 1, 1).isin(SCOOPABLE), F.lit(False)),
            "nearby_neutron": near,
            "has_population": people,
        }
    ).drop("bodies")


def in_deadzone(x: Column, y: Column, z: Column) -> Column:
    return (F.abs(x) <= SLAB) | (F.abs(y) <= SLAB) | (F.abs(z) <= SLAB)


def deadzone_sample(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """(line_no, chosen) of rows in the dead zone: every 256th in order of lines, the first included."""
    inside = rows.where(in_deadzone(F.col("coords.x"), F.col("coords.y"), F.col("coords.z"))).select("line_no")
    return with_row_index(inside, ["line_no"], "k").select("line_no", (F.col("k") % every == 0).alias("chosen"))


def keep(folded: DataFrame) -> DataFrame:
    """The rows a catalog is built of (name, coords, refuelable, neutron_star, line_no)."""
    marked = folded.join(deadzone_sample(folded), "line_no", "left")
    named = ~F.col("name").contains("-")
    rule = F.col("main_is_neutron") | (F.col("nearby_neutron") & F.col("refuelable")) | F.col("has_population") | named | F.coalesce("chosen", F.lit(False))
    return marked.where(rule).select("line_no", "name", "coords", "refuelable", F.col("nearby_neutron").alias("neutron_star"))


def first_by_name(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """One row a name, the first in ``order``; partial minima before the shuffle."""
    others = [c for c in rows.columns if c not in ("name", order)]
    return rows.groupBy("name").agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others])


def systems(kept: DataFrame) -> DataFrame:
    """(name, x, y, z, is_neutron_star, searchable) in the scene's frame."""
    x, y, z = to_scene(F.col("coords.x"), F.col("coords.y"), F.col("coords.z"))
    return first_by_name(kept).select("name", x, y, z, F.col("neutron_star").alias("is_neutron_star"), F.lit(True).alias("searchable"))


def build(raw: DataFrame) -> DataFrame:
    """Raw lines to systems."""
    return systems(keep(fold_bodies(raw)))
