"""Approximate nearest neighbours by collision counting (after QALSH, Huang et al., 2015).

Vectors lie in cells: those of one band of lengths whose direction is closest
to one centroid of a bounded sample.  A query asks the sample first; its 2k-th
best there bounds what it looks for, so cells that can't hold anything better
(by their lengths and their radius) are left out, exactly.  A block of a cell
keeps one sorted array of projections for each random line; a query's windows
on these arrays are centred at its own projection and widen in steps (virtual
rehashing) up to the distance of the k-th best so far.  A vector inside enough
of the windows collides, and all that collide are verified by their exact
inner product.  Largest inner product becomes nearest point by one more
coordinate that brings every vector of a block to the same length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import materialize

#: Vectors, and queries, that one task holds.
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Rows of the sample, those with the least hashes, and its bytes; centroids made of it, in rounds; bands of lengths, each so much shorter.
SAMPLE, SAMPLE_BYTES, CENTROIDS, ROUNDS, BANDS, SHORTER = 16_384, 64 << 20, 1024, 4, 16, 0.8
#: Lines, and those on which a vector must collide; half a window, in distances: a vector that far is inside with a
#: probability of 0.6, so it collides on 14 of 32 lines with a probability of 0.98.
LINES, THRESHOLD, HALF = 32, 14, 0.8416
#: Windows widen in these steps, as parts of the distance that the sample gives.
STEPS = (0.7, 0.84, 1.0)

_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, *, lines: int = LINES, threshold: int = THRESHOLD, exact: bool = False, seed: int = 7) -> tuple[list, list, list]:
    """The k best of one block found for each query, none of them below ``least``: parallel lists of query ids, ids and scores."""
    n, dim = x.shape
    longest = np.sqrt((x * x).sum(axis=1)).max() * (1 + 1e-12)
    sizes = np.sqrt((q * q).sum(axis=1))
    # |x' - q'|^2 = 2 - 2 x.q / (longest |q|)
    with np.errstate(invalid="ignore"):
        far = np.sqrt(np.clip(2 - 2 * least / (longest * sizes), 0, 4)) + 1e-9
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((dim + 1, lines))
    u = x / longest
    tail = np.sqrt(np.maximum(0.0, 1.0 - (u * u).sum(axis=1)))
    p = u @ a[:dim] + tail[:, None] * a[dim]
    order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T.astype(np.int32))
    lanes = np.take_along_axis(p.T, order, axis=1)
    pq = (q / sizes[:, None]) @ a[:dim]
    bounds: list[tuple[list, list]] = []

    def windows(level):
        while len(bounds) <= level:
            w = HALF * STEPS[len(bounds)] * far
            lo = np.stack([lanes[j].searchsorted(pq[:, j] - w, "left") for j in range(lines)], axis=1)
            hi = np.stack([lanes[j].searchsorted(pq[:, j] + w, "right") for j in range(lines)], axis=1)
            bounds.append((lo.tolist(), hi.tolist()))
        return bounds[level]

    out_q, out_id, out_score = [], [], []
    for i, own in enumerate(query_ids.tolist()):
        if least[i] > longest * sizes[i]:
            continue
        floor, count = least[i], np.zeros(n, np.int64)
        rough = np.full(n, -np.inf)
        for level, step in enumerate(STEPS):
            lo, hi = (b[i] for b in windows(level))
            if level:
                last_lo, last_hi = (b[i] for b in windows(level - 1))
                inside = [w for j, lane in enumerate(order) for w in (lane[lo[j] : last_lo[j]], lane[last_hi[j] : hi[j]])]
            else:
                inside = [lane[lo[j] : hi[j]] for j, lane in enumerate(order)]
            count += np.bincount(np.concatenate(inside), minlength=n)
            new = np.nonzero(((count >= threshold) | exact) & (rough == -np.inf))[0]
            rough[new] = x[new] @ q[i] if 2 * len(new) < n else (x @ q[i])[new]
            rough[new[ids[new] == own]] = np.nan  # verified, and no candidate
            held = rough[rough > floor]
            if len(held) >= k:
                floor = max(floor, np.partition(held, len(held) - k)[len(held) - k])
            if exact or step * far[i] >= math.sqrt(max(0.0, 2 - 2 * floor / (longest * sizes[i]))):
                break
        # a product's last digits depend on where a row lies, so what may be among the best is multiplied one by one
        found = np.nonzero(rough >= floor - 1e-9 * longest * sizes[i])[0]
        score = (x[found] * q[i]).sum(axis=1)
        best = np.lexsort((ids[found], -score))[:k]
        out_q += [own] * len(best)
        out_id += ids[found[best]].tolist()
        out_score += score[best].tolist()
    return out_q, out_id, out_score


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return v.where(~bad & F.exists("v", lambda e: e != 0))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((x * x).sum(axis=1))
    return x / size[:, None], size


def centroids(sample: np.ndarray, number: int, seed: int = 11) -> np.ndarray:
    """Directions that a few rounds of k-means make of a sample's."""
    u, _ = _directions(sample)
    c = u[np.random.default_rng(seed).choice(len(u), min(number, len(u)), replace=False)]
    for _ in range(ROUNDS):
        near = (u @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        held = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, u)
        c = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], c)
    return c


def _assign(c: np.ndarray, dim: int, longest: float):
    """Rows (id, v) with their cell, the distance of their direction from its centroid, and their length."""

    def run(batches):
        for b in batches:
            u, size = _directions(_matrix(b.column(1), dim))
            near = (u @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
            away = np.sqrt(((u - c[near]) ** 2).sum(axis=1))
            band = np.minimum(np.floor(np.log(longest / size) / -math.log(SHORTER) + 1e-9), BANDS - 1).astype(np.int64)
            columns = [pa.array(band * CENTROIDS + near, pa.int32()), pa.array(away, pa.float64()), pa.array(size, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=["id", "v", "cell", "away", "size"])

    return run


def _route(sample_ids, sample, c, cells, dim, k):
    """Rows (id, v) of queries: each with the least score that it looks for, in every cell that may hold such."""
    number, away, most, fewest = (np.array(x) for x in zip(*cells, strict=True))
    centre = c[number % CENTROIDS]

    def run(batches):
        for b in batches:
            ids, q = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            scores = q @ sample.T
            scores[ids[:, None] == sample_ids[None, :]] = -np.inf
            least = np.partition(scores, -2 * k, axis=1)[:, -2 * k] if scores.shape[1] >= 2 * k else np.full(len(ids), -np.inf)
            size = np.sqrt((q * q).sum(axis=1))[:, None]
            # a direction of the cell is at most ``away`` from its centroid; lengths lie between the fewest and the most
            best = np.minimum(q @ centre.T + size * away[None, :], size)
            bound = np.where(best > 0, best * most[None, :], best * fewest[None, :])
            least -= 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)) + 1e-300
            at, cell = np.nonzero(bound * (1 + 1e-9) + 1e-300 >= least[:, None])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(number[cell], pa.int32()), pa.array(least[at], pa.float64())], names=["id", "v", "cell", "least"])

    return run


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, exact: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    Queries are the ids divisible by ``every``; candidates all rows but those
    with the query's id.  Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids and vectors whose
    dimension isn't that of most rows (ties: the larger).  Of rows that share
    a query's id the least vector asks.  Ties go to the smaller id; with fewer
    than k candidates all are returned; repeated candidate rows each count.
    ``exact`` verifies every vector of the cells that a query asks.
    """
    spark = vectors.sparkSession
    valid = _valid(vectors, id_col, vec_col)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    sizes = valid.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest = sizes[0]
    own = valid.where(F.size("v") == dim)
    picked = own.withColumn("h", F.xxhash64("id", "v")).orderBy("h", "id").limit(max(2 * k + 1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("id", "v").toArrow()
    sample_ids, sample = picked.column("id").to_numpy(), _matrix(picked.column("v"), dim)
    c = centroids(sample, min(CENTROIDS, math.ceil(n / BLOCK)))
    assigned = materialize(own.mapInArrow(_assign(c, dim, longest), "id long, v array<double>, cell int, away double, size double"), "assigned")
    by_cell = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("size").alias("most"), F.min("size").alias("fewest")).collect()  # at most CENTROIDS times BANDS rows
    asked = own.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    cells = [(r["cell"], r["away"] * (1 + 1e-9) + 1e-9, r["most"], r["fewest"]) for r in by_cell]
    visits = materialize(asked.mapInArrow(_route(sample_ids, sample, c, cells, dim, k), "id long, v array<double>, cell int, least double"), "visits")
    place = F.xxhash64("id", F.monotonically_increasing_id())  # repeated rows are dealt out, too
    base_rows = assigned.withColumn("h", place)

    def search(visits: DataFrame, exact: bool) -> DataFrame:
        visited = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # as many rows
        dealt = spark.createDataFrame([(r["cell"], math.ceil(r["n"] / BLOCK), math.ceil(visited[r["cell"]] / QUERY_BLOCK)) for r in by_cell if r["cell"] in visited], "cell int, blocks int, slices int")
        base = base_rows.join(F.broadcast(dealt), "cell")
        base = base.select(F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("least"), "cell", F.pmod("h", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        queries = visits.join(F.broadcast(dealt), "cell")
        queries = queries.select(F.lit(1).alias("kind"), "id", "v", "least", "cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def run(t: pa.Table) -> pa.Table:
            kind, ids, least = (t.column(x).to_numpy() for x in ("kind", "id", "least"))
            v = _matrix(t.column("v"), dim)
            x, q = kind == 0, kind == 1
            if not x.any() or not q.any():
                return _SCHEMA.empty_table()
            got = search_block(ids[x], v[x], ids[q], v[q], least[q], k, exact=exact)
            return pa.table([pa.array(c, f.type) for c, f in zip(got, _SCHEMA, strict=True)], schema=_SCHEMA)

        found = base.unionByName(queries).groupBy("cell", "block", "slice").applyInArrow(run, "query_id long, vec_id long, score double")
        return materialize(found, "found")

    found = search(visits, exact)
    if not exact:
        # a query that found too few, which is rare, has every vector of its cells verified
        counts = found.groupBy(F.col("query_id").alias("id")).count()
        few = materialize(visits.select("id").distinct().join(counts, "id", "left").where(F.coalesce("count", F.lit(0)) < k).select("id"), "few")
        if not few.isEmpty():
            again = search(materialize(visits.join(few, "id", "left_semi"), "again"), True)
            found = found.join(few.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(again)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
