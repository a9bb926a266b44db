"""Search among points (star_id, x, y, z): balls, nearest, rays, range joins, partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geometry import AXES, cell, dist_sq, f32, in_box
from waymark.functions.ranking import with_row_index
from waymark.sources.tables import materialize

#: Rows of a probe side up to which it is broadcast.
BROADCAST_ROWS = 100_000
#: A ray ends here; boxes that its cone is covered by, each twice as long as the one before.
RAY_LENGTH, RAY_BOXES = 240.0, 6
#: Times a box grows fourfold before the whole table is read.
GROWS = 4
#: Rows of a table up to which its values are held for the exact median.
EXACT = 100_000


def within_radius(stars: DataFrame, p: tuple, r: float) -> DataFrame:
    """The closed ball around a point, with ``d2``."""
    return stars.where(in_box(p, r)).withColumn("d2", dist_sq("", p)).where(F.col("d2") <= f32(r) * f32(r))


def nearest(stars: DataFrame, p: tuple, k: int = 1, start: float | None = None) -> DataFrame:
    """The k nearest to a point; ties go to the smaller id.

    Without ``start`` each task keeps k rows of its part of the table, no
    shuffle of it.  With ``start`` (the side of a stored table's cells) a box
    around the point grows until its ball holds k stars, so only files and row
    groups near the point are read; in empty space the whole table is.
    """
    measured = stars.withColumn("d2", dist_sq("", p))
    if start:
        r = start
        for _ in range(GROWS):
            ball = measured.where(in_box(p, r)).where(F.col("d2") <= f32(r) * f32(r))
            if ball.limit(k).count() == k:
                return ball.orderBy("d2", "star_id").limit(k)
            r *= 4
    return measured.orderBy("d2", "star_id").limit(k)


def range_join(left: DataFrame, right: DataFrame, r: float, *, small_left: bool | None = None) -> DataFrame:
    """Pairs of a (l_ columns) and b (r_ columns) at most r apart, with ``d2``.

    Cells have side r, the left side goes to its 27 neighbouring cells, so
    each pair meets in one cell and the join is an equi-join.  The left side
    is broadcast if its rows are few, by their number or because the caller
    knows.
    """
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], *cell("", r))
    step = F.array(*[F.struct(*[F.lit(d).cast("long").alias(c) for c, d in zip(AXES, ds, strict=True)]) for ds in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))])
    a = a.select("*", *cell("l_", r), F.explode(step).alias("s"))
    a = a.select(*[f"l_{c}" for c in left.columns], *[(F.col(f"c{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in AXES])
    few = left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS if small_left is None else small_left
    pairs = (F.broadcast(a) if few else a).join(b, [f"c{c}" for c in AXES])
    return pairs.drop(*[f"c{c}" for c in AXES]).withColumn("d2", dist_sq("l_", "r_")).where(F.col("d2") <= f32(r) * f32(r))


def radius_capped(probes: DataFrame, stars: DataFrame, r: float, n: int) -> DataFrame:
    """Of each probe's ball the n nearest (probe_id, star_id, d2, rank); ties go to the smaller id."""
    w = Window.partitionBy("l_probe_id").orderBy("d2", "r_star_id")
    out = range_join(probes, stars, r).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.select(F.col("l_probe_id").alias("probe_id"), F.col("r_star_id").alias("star_id"), "d2", "rank")


def nearest_join(probes: DataFrame, stars: DataFrame, start: float) -> DataFrame:
    """Each probe's nearest star (probe_id, star_id, d2).

    Balls of doubled radius until each probe has a star in its own; what has
    one is done, so only probes in empty space see more than one round.
    """
    box = bbox(stars).first()
    if box["n"] == 0:
        return probes.select("probe_id", F.lit(None).cast("long").alias("star_id"), F.lit(None).cast("float").alias("d2"))
    far = probes.agg(*[F.max(F.greatest(F.abs(F.col(c) - F.lit(box[f"min_{c}"])), F.abs(F.col(c) - F.lit(box[f"max_{c}"])))).alias(c) for c in AXES]).first()
    most = 1.001 * math.sqrt(sum((far[c] or 0.0) ** 2 for c in AXES)) + start
    done, r, left = None, start, probes
    while True:
        r = min(r, most)
        best = range_join(left, stars, r).groupBy(F.col("l_probe_id").alias("probe_id")).agg(F.min(F.struct("d2", F.col("r_star_id").alias("star_id"))).alias("m")).select("probe_id", "m.star_id", "m.d2")
        best = materialize(best, "nearest")
        done = best if done is None else done.unionByName(best)
        if r >= most:
            return done
        left = materialize(left.join(best, "probe_id", "left_anti"), "left")
        if left.isEmpty():
            return done
        r *= 2


def bbox(stars: DataFrame) -> DataFrame:
    """Number of points, extent of each axis, and the widest axis (ties: the last)."""
    a = stars.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES])
    wide = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES]
    top = F.greatest(*wide)
    return a.withColumn("widest", F.when(wide[2] == top, "z").when(wide[1] == top, "y").otherwise("x"))


def along_ray(origin: tuple, direction: tuple, tolerance: float, threshold: float = 0.0) -> Column:
    """Boxes that cover the cone (or, with ``threshold``, the tube) around a ray of unit direction: plain comparisons, which reach Parquet's statistics."""
    lo, inside = 0.0, F.lit(False)
    for i in range(RAY_BOXES):
        hi = RAY_LENGTH / 2 ** (RAY_BOXES - 1 - i)
        wide = (threshold or tolerance * hi) * 1.000001 + 1e-6
        box = F.lit(True)
        for c, o, d in zip(AXES, origin, direction, strict=True):
            ends = (o + lo * d, o + hi * d)
            pad = wide + 1e-6 * max(map(abs, ends))
            box = box & F.col(c).between(F.lit(min(ends) - pad), F.lit(max(ends) + pad))
        inside, lo = inside | box, hi
    return inside


def on_ray(stars: DataFrame, origin: tuple, direction: tuple, tolerance: float, threshold: float = 0.0) -> DataFrame | None:
    """Points in the cone around a ray (with ``threshold``, at most so far from it), with t (along it) and ang2 (squared tangent); None if the ray has no direction."""
    size = math.sqrt(sum(d * d for d in direction))
    if size < 1e-10:
        return None
    d = [v / size for v in direction]
    rel = [F.col(c).cast("double") - F.lit(float(o)) for c, o in zip(AXES, origin, strict=True)]
    t = sum((u * F.lit(v) for u, v in zip(rel[1:], d[1:], strict=True)), rel[0] * F.lit(d[0]))
    off = [u - t * F.lit(v) for u, v in zip(rel, d, strict=True)]
    perp = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    near = stars.where(along_ray(origin, d, tolerance, threshold))
    hit = near.withColumn("t", t).withColumn("ang2", perp / (F.col("t") * F.col("t"))).where((F.col("t") > 0) & (F.col("t") <= RAY_LENGTH))
    within = F.col("ang2") * F.col("t") * F.col("t") <= threshold * threshold if threshold else F.col("ang2") <= tolerance * tolerance
    return hit.where(within)


def ray_pick(stars: DataFrame, origin: tuple, direction: tuple, tolerance: float) -> DataFrame:
    """The point that looks closest to the ray; ties go to the smaller id."""
    hit = on_ray(stars, origin, direction, tolerance)
    if hit is None:
        return stars.limit(0).withColumns({"t": F.lit(0.0), "ang2": F.lit(0.0)})
    return hit.orderBy("ang2", "star_id").limit(1)


def route_pick(nodes: DataFrame, origin: tuple, direction: tuple, threshold: float) -> DataFrame:
    """The first node along the ray that is at most ``threshold`` from it."""
    hit = on_ray(nodes, origin, direction, 0.0, threshold)
    if hit is None:
        return nodes.limit(0).withColumns({"t": F.lit(0.0), "ang2": F.lit(0.0)})
    return hit.orderBy("t", "star_id").limit(1)


def _medians(parts: DataFrame) -> DataFrame:
    """(part, median) of (part, value), the lower of two middle values, by places in a sort over ranges; a part without a value has no row."""
    held = parts.where(F.col("value").isNotNull())
    placed = with_row_index(held.withColumn("own", F.monotonically_increasing_id()), ["part", "value", "own"], "place")
    middle = placed.groupBy("part").agg((F.min("place") + F.floor((F.count("*") - 1) / 2)).alias("place"))
    return placed.join(F.broadcast(middle.select("place")), "place", "left_semi").select("part", F.col("value").alias("median"))


def spatial_partition(stars: DataFrame, depth: int, exact: int = EXACT) -> DataFrame:
    """``stars`` with ``part``: halves of halves at the median of the widest axis, 2^depth parts.

    A level is one aggregation by part (2^level rows) and a join with its
    result.  Medians are exact: of a table of at most ``exact`` rows all values
    of a part are held at once, of a larger one they come from places in a
    sort.  A star without a coordinate isn't beyond any median of it.
    """
    out = stars.withColumn("part", F.lit(0))
    small = stars.limit(exact + 1).count() <= exact
    wx, wy, wz = (F.col(f"w{c}") for c in AXES)
    axis = F.when(wz >= F.greatest(wx, wy), "z").when(wy >= wx, "y").otherwise("x")
    value, median = (F.when(F.col("axis") == "z", F.col(f"{p}z")).when(F.col("axis") == "y", F.col(f"{p}y")).otherwise(F.col(f"{p}x")) for p in ("", "m"))
    for _ in range(depth):
        widths = [(F.max(c) - F.min(c)).alias(f"w{c}") for c in AXES]
        if small:
            by = out.groupBy("part").agg(*widths, *[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"m{c}") for c in AXES])
            by = by.withColumn("axis", axis).select("part", "axis", median.alias("median"))
        else:
            by = materialize(out.groupBy("part").agg(*widths).select("part", axis.alias("axis")), "axes")
            medians = materialize(_medians(out.join(F.broadcast(by), "part").select("part", value.alias("value"))), "medians")
            by = by.join(medians, "part", "left")
        beyond = F.coalesce(value > F.col("median"), F.lit(False))
        out = out.join(F.broadcast(by), "part").withColumn("part", F.col("part") * 2 + beyond.cast("int")).drop("axis", "median")
    return out
