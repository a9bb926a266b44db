"""Single-precision geometry on columns x, y, z.

``+ - *`` of floats stay floats in Spark; division and roots are doubles, and
a cast back gives the single-precision result bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def f32(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(float(v))).cast("float")


def to_scene(x: Column, y: Column, z: Column) -> list[Column]:
    """Light-years to the scene's frame: thousands, x mirrored."""
    return [f32(-(x / 1000)).alias("x"), f32(y / 1000).alias("y"), f32(z / 1000).alias("z")]


def dist_sq(a: str | tuple, b: str | tuple) -> Column:
    """Squared distance, summed as (x + y) + z; a point is a column prefix or three values."""

    def parts(p):
        return [F.col(f"{p}{c}") for c in AXES] if isinstance(p, str) else [f32(v) for v in p]

    dx, dy, dz = (u - v for u, v in zip(parts(a), parts(b), strict=True))
    return dx * dx + dy * dy + dz * dz


def root(c: Column) -> Column:
    return f32(F.sqrt(c))


def dist(a, b) -> Column:
    return root(dist_sq(a, b))


def in_box(p: tuple, r: float, prefix: str = "") -> Column:
    """The box around a ball: plain comparisons, which reach Parquet's statistics as no distance does."""
    pad = abs(r) * 1.000001 + 1e-6 * max(1.0, *(abs(v) for v in p))
    c = F.lit(True)
    for axis, v in zip(AXES, p, strict=True):
        c = c & F.col(prefix + axis).between(F.lit(v - pad), F.lit(v + pad))
    return c


def cell(prefix: str, side: float) -> list[Column]:
    """Grid cell of a point; taken in double precision, so the single-precision test decides alone."""
    return [F.floor(F.col(prefix + c).cast("double") / F.lit(side * 1.000001)).cast("long").alias(f"c{c}") for c in AXES]


def jump_range(fuel: Column, mult: Column, *, opt_mass, boost, max_fuel, rating, fuel_class, base_mass) -> Column:
    """Light-years of one jump: opt_mass * boost * (1000 * min(max_fuel, fuel) * mult / rating)^(1 / class) / (base_mass + fuel)."""
    burnt = F.least(F.lit(max_fuel), fuel) * mult * 1000 / F.lit(rating)
    return F.lit(opt_mass) * F.lit(boost) * F.pow(burnt, F.lit(1.0) / F.lit(fuel_class)) / (F.lit(base_mass) + fuel)
