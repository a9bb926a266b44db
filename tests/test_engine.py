"""The engine against its fixtures and small models."""

import json
import math
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from waymark.functions.geometry import dist, jump_range
from waymark.functions.ranking import with_row_index
from waymark.functions.text import overlap, parse_float, systems_query
from waymark.operators import catalog, journal, names, route, spatial
from waymark.plans.engine import Engine, NotLoaded, RouteState
from waymark.sources import readers, writers
from waymark.sources.tables import RAW_SYSTEM, materialize
from waymark.streaming.journal import Tracker, advance, persisted, stream_jumps, track


def points(spark, coords):
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(coords)], "star_id long, x float, y float, z float")


def on_x(spark, xs):
    return points(spark, [(x, 0, 0) for x in xs])


def name_table(spark, some):
    return spark.createDataFrame([(n,) for n in some], "name string")


# Points


def test_nearest_fixtures(spark):
    assert spatial.nearest(points(spark, []), (0, 0, 0)).first() is None
    one = points(spark, [(1, 2, 3)])
    assert spatial.nearest(one, (1, 2, 3)).first()["d2"] == 0 and spatial.nearest(one, (0, 0, 0)).first()["d2"] == 14
    five = points(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)])
    assert [spatial.nearest(five, p).first()[k] for p, k in (((0, 0, 0), "d2"), ((1, 1, 1), "d2"), ((0.5, 0, 0), "d2"), ((0.5, 0, 0), "star_id"))] == [0, 0, 0.25, 0]
    grid = points(spark, [(x, y, z) for x in range(10) for y in range(10) for z in range(10)])
    assert [spatial.nearest(grid, p).first()["d2"] for p in ((0, 0, 0), (9, 9, 9), (0.5, 0.5, 0.5))] == [0, 0, 0.75]
    negative = points(spark, [(-1, -1, -1), (1, 1, 1), (0, 0, 0)])
    assert [spatial.nearest(negative, (v, v, v)).first()["x"] for v in (-0.9, 0.9)] == [-1, 1]


def test_radius_fixtures(spark):
    four = on_x(spark, (0, 1, 2, 10))
    assert [spatial.within_radius(four, (0, 0, 0), r).count() for r in (1.5, 2.5, 100, 1.0)] == [2, 3, 4, 2]
    probe = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "probe_id long, x float, y float, z float")
    got = spatial.radius_capped(probe, on_x(spark, range(10)), 5.0, 3).orderBy("rank").collect()
    assert [r["star_id"] for r in got] == [0, 1, 2]


@pytest.mark.parametrize("small", [True, False, None])
def test_range_join_matches_brute_force(spark, small):
    rng = np.random.default_rng(0)
    p = np.float32(rng.uniform(-1, 1, (300, 3)))
    s = points(spark, p.tolist())
    got = {(r["l_star_id"], r["r_star_id"]) for r in spatial.range_join(s, s, 0.2, small_left=small).collect()}
    d = p[:, None] - p[None]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d2 <= np.float32(0.2) * np.float32(0.2)), strict=True)}


def test_range_join_is_an_equi_join(spark):
    s = on_x(spark, range(5))
    plan = spatial.range_join(s, s, 1.5, small_left=False)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_join_finds_far_stars(spark):
    probes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 900.0, 0.0, 0.0), (2, -3.0, 4.0, 0.0)], "probe_id long, x float, y float, z float")
    got = {r["probe_id"]: (r["star_id"], r["d2"]) for r in spatial.nearest_join(probes, on_x(spark, (0, 1, 10)), 0.5).collect()}
    assert got == {0: (0, 0.0), 1: (2, 890.0**2), 2: (0, 25.0)}
    assert {r["star_id"] for r in spatial.nearest_join(probes, points(spark, []), 0.5).collect()} == {None}


def test_ray(spark):
    s = points(spark, [(1, 0.01, 0), (2, 0, 0), (-1, 0, 0), (300, 0, 0), (5, 5, 0)])
    assert spatial.ray_pick(s, (0, 0, 0), (2, 0, 0), 0.05).first()["star_id"] == 1
    assert spatial.ray_pick(s, (0, 0, 0), (0, 0, 0), 0.05).first() is None
    assert spatial.ray_pick(s, (0, 0, 0), (0, 0, 1), 0.05).first() is None
    assert spatial.route_pick(s, (0, 0, 0), (1, 0, 0), 0.1).first()["star_id"] == 0


def test_partitions_are_halves(spark):
    rng = np.random.default_rng(1)
    got = spatial.spatial_partition(points(spark, rng.uniform(-1, 1, (64, 3)).tolist()), 3).groupBy("part").count().collect()
    assert sorted(r["count"] for r in got) == [8] * 8


def test_medians_are_exact_beyond_a_summary(spark):
    rng = np.random.default_rng(1)
    s = points(spark, np.round(rng.uniform(-1, 1, (300, 3)), 1).tolist())
    small, large = ({r["star_id"]: r["part"] for r in spatial.spatial_partition(s, 3, exact=e).collect()} for e in (100_000, 0))
    assert small == large


def slow_partition(points, depth):
    """The parts of points by numpy, nan for a missing coordinate."""
    part, p = np.zeros(len(points), int), np.array(points, np.float32)
    for _ in range(depth):
        new = part * 2
        for own in (np.nonzero(part == k)[0] for k in set(part.tolist())):
            x, y, z = (np.nanmax(v) - np.nanmin(v) for v in p[own].T)
            v = p[own, 2 if z >= max(x, y) else 1 if y >= x else 0]
            held = np.sort(v[~np.isnan(v)])
            new[own] += v > held[(len(held) - 1) // 2]
        part = new
    return dict(enumerate(part.tolist()))


def test_medians_are_exact_below_the_bound_too(spark):
    p = np.float32(np.random.default_rng(3).uniform(-1, 1, (80_000, 3)))
    s = spark.createDataFrame(pa.table({"star_id": np.arange(len(p)), **{c: p[:, i] for i, c in enumerate("xyz")}})).repartition(6)
    got = spatial.spatial_partition(s, 3).toArrow()
    assert dict(zip(got["star_id"].to_pylist(), got["part"].to_pylist(), strict=True)) == slow_partition(p, 3)


@pytest.mark.parametrize("exact", [100_000, 0])
def test_stars_without_a_coordinate_stay(spark, exact):
    p = np.random.default_rng(5).uniform(-1, 1, (200, 3)).astype(np.float32)
    p[::7, 0], p[::11, 2], p[3] = np.nan, np.nan, np.nan
    s = points(spark, p.tolist()).replace(float("nan"), None)
    got = {r["star_id"]: r["part"] for r in spatial.spatial_partition(s, 3, exact=exact).collect()}
    assert got == slow_partition(p, 3)


def test_growing_boxes_find_the_nearest(spark, tmp_path):
    p = np.float32(np.random.default_rng(4).uniform(-1, 1, (400, 3)))
    s = points(spark, p.tolist())
    for q in ((0.1, 0.2, 0.3), (50.0, 0.0, 0.0)):
        assert [r["star_id"] for r in spatial.nearest(s, q, 7, start=0.05).collect()] == [r["star_id"] for r in spatial.nearest(s, q, 7).collect()]
    writers.write_stars(s.withColumn("name", F.lit("s")), str(tmp_path / "s"), 0.2, 4)
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert {"cx", "cy", "cz"} <= set(stored.columns)
    plan = spatial.ray_pick(stored, (-0.5, 0, 0), (1, 0.1, 0), 0.01)._jdf.queryExecution().executedPlan().toString()
    assert "Or(And(And(" in plan.split("PushedFilters")[1]


def test_box_filter_reaches_parquet(spark, tmp_path):
    writers.write_stars(points(spark, [(i, i, i) for i in range(100)]).withColumn("name", F.lit("s")), str(tmp_path / "s"), 10.0, 4)
    plan = spatial.within_radius(readers.star_table(spark, str(tmp_path / "s")), (5, 5, 5), 2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x)" in plan and "GreaterThanOrEqual(x" in plan


# Names

TREE = ["ROM", "ROW", "ROMAN"]


def test_ids_in_level_order(spark):
    assert [r["name"] for r in names.ranked(name_table(spark, TREE)).orderBy("star_id").collect()] == TREE
    listed = ["apple", "application", "apply", "banana", "band"]
    ids = {r["name"]: r["star_id"] for r in names.ranked(name_table(spark, listed)).collect()}
    assert sorted(ids, key=ids.get) == slow_ids(listed)


def slow_ids(some):
    keys = sorted(set(some))

    def depth(name):
        return sum(1 for i in range(1, len(name) + 1) if name[:i] in keys or len({k[i : i + 1] for k in keys if k.startswith(name[:i]) and len(k) > i}) > 1)

    return sorted(keys, key=lambda k: (depth(k), k.encode()))


def test_ids_match_model(spark):
    rng = np.random.default_rng(3)
    some = sorted({"".join(rng.choice(list("abA")) for _ in range(rng.integers(1, 7))) for _ in range(60)})
    assert [r["name"] for r in names.ranked(name_table(spark, some)).orderBy("star_id").collect()] == slow_ids(some)


@pytest.mark.parametrize(
    ("some", "prefix", "limit", "want"),
    [
        (["apple", "application", "apply", "banana", "band"], "app", 9, 3),
        (["Apple", "APPLICATION", "Apply", "Banana"], "ApP", 9, 3),
        (["a1", "a2", "a3", "a4", "a5"], "a", 3, 3),
        (["a1", "a2", "a3", "a4", "a5"], "a", 10, 5),
        (["apple", "banana"], "xyz", 5, 0),
        (["apple", "banana"], "b", 5, 1),
        (["apple", "banana"], "", 5, 2),
        (["Éa"], "éa", 5, 0),
        (["a"], "a", 0, 0),
    ],
)
def test_suggestions(spark, some, prefix, limit, want):
    assert names.suggest_prefix(name_table(spark, some), prefix, limit).count() == want


def test_suggestion_order(spark):
    got = names.suggest_prefix(name_table(spark, ["app", "apple", "application"]), "app", 9).orderBy("rank").collect()
    assert [r["name"] for r in got] == ["app", "apple", "application"]
    assert names.suggest_lex(name_table(spark, ["Éa"]), "éa", 5).count() == 1
    assert names.find_ci(name_table(spark, ["b", "A", "a"]), "A").collect()[0][:] == ("A", 0)


def test_labels(spark):
    tree = {(r["node"], r["depth"], r["parent"], r["label"], r["is_terminal"]) for r in names.radix_nodes(name_table(spark, TREE)).collect()}
    assert tree == {("RO", 1, "", "RO", False), ("ROM", 2, "RO", "M", True), ("ROW", 2, "RO", "W", True), ("ROMAN", 3, "ROM", "AN", True)}
    df = spark.createDataFrame([("abc", "bcd"), ("a", "b"), ("aa", "aa"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(overlap(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, 0]


def test_palette_and_navigation(spark):
    nodes = names.radix_nodes(name_table(spark, [*TREE, "ROMAW"]))
    got = {r["node"]: (r["number"], r["bits"]) for r in names.encoded(nodes, 2).collect()}
    assert got["ROW"] == got["ROMAW"] == (0, 8) and sorted(b for _, b in got.values()) == [8, 8, 8, 32, 32, 32]
    assert [r["label"] for r in names.children(nodes, "RO").collect()] == ["M", "W"] and names.children(nodes, "ROW").count() == 0
    assert names.parent(nodes, "ROM").first()["node"] == "RO" and names.parent(nodes, "RO").count() == 0
    stats = names.catalog_stats(name_table(spark, TREE)).first()
    assert (stats["nodes"], stats["labels_8"], stats["labels_16"], stats["labels_32"]) == (4, 4, 0, 0)


def test_names_need_no_prefix_as_a_key(spark):
    plan = names.paths(name_table(spark, TREE))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_addresses(spark):
    df = spark.createDataFrame([(["Sol", "a b+c", "é~!*'()/?"],)], "n array<string>")
    assert df.select(systems_query(F.col("n"))).first()[0] == "systemName[]=Sol&systemName[]=a%20b%2Bc&systemName[]=%C3%A9~!*'()%2F%3F"


def test_row_index_keeps_columns_of_any_name(spark):
    df = spark.range(20).select(F.col("id").alias("v"), F.col("id").alias("mid"), F.lit("x").alias("part"), F.lit("y").alias("offset"))
    got = with_row_index(df, ["v"], "k").collect()
    assert all((r["k"], r["mid"], r["part"], r["offset"]) == (r["v"], r["v"], "x", "y") for r in got) and len(got) == 20


def test_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from waymark.sources import tables

    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(tables.NoSharedFolder):
        tables.shared_dir(Session)


def test_row_index(spark):
    got = with_row_index(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), ["v"], "k").collect()
    assert all(r["v"] == r["k"] for r in got) and len(got) == 1000
    assert with_row_index(spark.range(0).select(F.col("id").alias("v")), ["v"], "k").count() == 0


# Catalog build

G, N = ("G (White-Yellow) Star", 0.0, True, None), ("Neutron Star", 0.0, True, None)


def raw(spark):
    far = (1000.0, 1000.0, 1000.0)
    rows = [
        (0, "Sol", (0.0, 0.0, 0.0), [G, ("Planet", 1.0, False, 100)]),
        (1, "Alpha-1", far, [N]),
        (2, "Beta-2", far, [("M (Red dwarf) Star", 0.0, True, None), ("Neutron Star", 3000.0, False, None)]),
        (3, "Beta-3", far, [("M (Red dwarf) Star", 0.0, True, None), ("Neutron Star", 3000.5, False, None)]),
        (4, "Gamma-4", far, [("Black Hole", 0.0, True, None), ("Neutron Star", None, False, None)]),
        (5, "Delta-5", (0.0, 5000.0, 5000.0), []),
        (6, "Sol", (9.0, 9.0, 9.0), []),
        (7, "No-bodies", far, None),
    ]
    return spark.createDataFrame(rows, "line_no long, " + RAW_SYSTEM)


def test_catalog_build(spark):
    kept = {r["line_no"]: (r["refuelable"], r["neutron_star"]) for r in catalog.keep(catalog.fold_bodies(raw(spark))).collect()}
    assert kept == {0: (True, False), 1: (False, True), 2: (True, True), 4: (True, True), 6: (False, False)}
    built = {r["name"]: r for r in catalog.build(raw(spark)).collect()}
    assert set(built) == {"Sol", "Alpha-1", "Beta-2", "Gamma-4"} and built["Sol"]["x"] == 0
    assert tuple(built["Alpha-1"][c] for c in "xyz") == (-1, 1, 1)


def test_every_256th_of_the_dead_zone(spark):
    rows = spark.range(1000).select(F.col("id").alias("line_no"), F.struct(F.lit(0.0).alias("x"), F.lit(5000.0).alias("y"), F.lit(5000.0).alias("z")).alias("coords"))
    assert sorted(r["line_no"] for r in catalog.deadzone_sample(rows).where("chosen").collect()) == [0, 256, 512, 768]


def test_system_dump(spark, tmp_path):
    systems = [{"name": f"S{i}", "coords": {"x": i, "y": 2.5, "z": -i}, "bodies": [{"subType": "Neutron Star", "distanceToArrival": 0, "mainStar": True}]} for i in range(20)]
    path = tmp_path / "systems.json"
    path.write_text("[\n" + ",\n".join(json.dumps(s) for s in systems) + "\n]\n")
    got = readers.dump_systems(readers.numbered_lines(spark, str(path))).orderBy("line_no").collect()
    assert [(r["line_no"], r["name"], r["coords"]["x"]) for r in got] == [(i + 1, f"S{i}", float(i)) for i in range(20)]
    line = spark.createDataFrame([('{"name":"Sol","coords":{"x":1.5,"y":-2,"z":3e1}},',), ("[",), ("",), ('{"name":"No"}',)], "v string")
    assert [r[0] and tuple(r[0]) for r in line.select(readers.scan_line(F.col("v"))).collect()] == [("Sol", 1.5, -2.0, 30.0), None, None, None]
    bad = tmp_path / "bad.json"
    bad.write_text("[\n{broken,\n]\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.dump_systems(readers.numbered_lines(spark, str(bad))).collect()


def test_star_arrays(spark, tmp_path):
    data = b"".join(struct.pack("<3f", i, i + 0.5, -i) for i in range(100))
    (tmp_path / "s.bin").write_bytes(data)
    stars = readers.star_array(spark, str(tmp_path / "s.bin"))
    assert b"".join(writers.star_bytes(stars)) == data
    writers.write_star_array(stars, str(tmp_path / "again.bin"))
    assert (tmp_path / "again.bin").read_bytes() == data
    flat = writers.flatten_coords(stars.withColumn("r", F.col("star_id") % 2), "r")
    assert writers.unflatten_coords(flat, "r").count() == 100


# Routes


def ids(spark, xs, a, b, **kw):
    return route.find_route(on_x(spark, xs), (a, 0, 0), (b, 0, 0), **kw)


def test_route_fixtures(spark):
    assert ids(spark, (0, 0.2), 0, 0.2) == [0, 1]
    with pytest.raises(route.RouteNotFound):
        ids(spark, (0, 0.2, 0.4), 0, 0.4)
    assert ids(spark, (0, 0.2, 0.4), 0, 0.4, drop_worst=False) == [0, 1, 2]
    reports = []
    assert ids(spark, (0, 0.2, 0.4, -0.1), 0, 0.4, on_report=reports.append) == [0, 1, 2]
    assert [r["depth"] for r in reports] == [0, 0] and reports[1]["route"] == [0]
    assert ids(spark, (0, 0.2), 0, 0) == [0]
    for xs in ((0, 1), ()):
        with pytest.raises(route.RouteNotFound):
            ids(spark, xs, 0, 1)


def slow_route(p, a, b, reach, width):
    """Beam-limited breadth-first search in plain Python."""

    def d2(i, j):
        d = p[i] - p[j]
        return np.float32(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    queue, seen, prev = [a], {a}, {}
    while queue:
        nxt = []
        for i in queue:
            for j in sorted((j for j in range(len(p)) if j != i and d2(i, j) <= np.float32(reach) * np.float32(reach)), key=lambda j: (d2(i, j), j))[:1024]:
                if j not in seen:
                    seen.add(j)
                    prev[j] = i
                    nxt.append(j)
        if b in seen:
            path = [b]
            while path[-1] != a:
                path.append(prev[path[-1]])
            return path[::-1]
        queue = sorted(nxt, key=lambda j: (np.float32(np.sqrt(d2(j, b))), j))[: min(width, len(nxt) - 1)] if nxt else []
    return None


@pytest.mark.parametrize(("reach", "width"), [(0.35, 1024), (0.3, 6)])
def test_route_matches_model(spark, reach, width):
    p = np.float32(np.random.default_rng(9).uniform(-1, 1, (250, 3)))
    s = points(spark, p.tolist())
    try:
        got = route.find_route(s, tuple(map(float, p[3])), tuple(map(float, p[7])), reach=reach, width=width)
    except route.RouteNotFound:
        got = None
    assert got == slow_route(p, 3, 7, reach, width)


def test_ship(spark):
    df = spark.range(1).select(jump_range(F.lit(32.0), F.lit(4.0), opt_mass=1050.0, boost=1.0, max_fuel=5.0, rating=12.0, fuel_class=2.45, base_mass=400.0).alias("j"))
    assert df.first()["j"] == pytest.approx(1050 * (1000 * 5 * 4 / 12) ** (1 / 2.45) / 432)


def test_progress(spark):
    nodes = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "system string, seq int")
    seen = spark.createDataFrame([(1, i, s) for i, s in enumerate("BACX")], "cmdr int, t int, system string")
    assert [r["progress"] for r in route.progress(seen, nodes, "cmdr", ["t"]).orderBy("t").collect()] == [2, 2, 3, 3]
    state = RouteState()
    state.set_route(["A", "B", "C"])
    got = []
    for s in "BACX":
        state.mark_visited(s)
        got.append(state.progress)
    state.set_progress(1)
    assert got == [2, 2, 3, 3] and state.progress == 1
    state.clear_route()
    assert state.progress == 0


def test_reconstruct(spark):
    links = spark.createDataFrame([(3, 2), (2, 1), (1, 0), (9, 8)], "child long, parent long")
    assert [r["node"] for r in route.reconstruct(spark, links, 3).orderBy("step").collect()] == [3, 2, 1, 0]
    assert [tuple(r) for r in route.reconstruct(spark, links, 77).collect()] == [(77, 0)]
    long = spark.range(500).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    assert [r["node"] for r in route.reconstruct(spark, long, 500).orderBy("step").collect()] == list(range(500, -1, -1))
    with pytest.raises(ValueError, match="loop"):
        route.reconstruct(spark, spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), 1, most=8)


# Journal


def jump(system):
    return json.dumps({"timestamp": "2024-01-01T00:00:00Z", "event": "FSDJump", "StarSystem": system, "SystemAddress": 1, "StarPos": [1000, 2000, -3000], "JumpDist": 1.0, "FuelUsed": 1.0, "FuelLevel": 1.0})


LINES = [jump("A"), '{"event":"Docked"}', jump("A"), "", jump("B"), jump("A")]


def test_journal_batch(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, value string").withColumn("cmdr", F.lit(1))
    jumps = readers.journal_jumps(lines).withColumn("cmdr", F.lit(1))
    assert [r["StarSystem"] for r in jumps.orderBy("line_no").collect()] == ["A", "A", "B", "A"]
    assert [r["StarSystem"] for r in journal.changes(jumps, ["cmdr"], ["line_no"], "StarSystem").orderBy("line_no").collect()] == ["A", "B", "A"]
    assert journal.last_jump(jumps.drop("event"), ["cmdr"], ["line_no"]).first()["StarSystem"] == "A"
    assert tuple(journal.locations(jumps).first()[c] for c in "xyz") == (-1.0, 2.0, -3.0)


def test_latest_journal(spark, tmp_path):
    for name, at in (("Journal.1.log", 100), ("Journal.2.log", 300), ("Journal.3.log", 200), ("Other.log", 900)):
        (tmp_path / name).write_text("x")
        import os

        os.utime(tmp_path / name, (at, at))
    assert readers.latest_journal(spark, str(tmp_path)).first()["path"].endswith("Journal.2.log")


class Seen:
    """A sink that keeps rows; waits until they are what is wanted."""

    def __init__(self):
        self.rows = []

    def __call__(self, batch, number):
        self.rows += [tuple(r) for r in batch.select("system", batch.columns[-1]).collect()]

    def until(self, want, tracker):
        end = time.time() + 60
        while time.time() < end and self.rows != want:
            assert tracker.query.exception() is None
            time.sleep(0.1)
        assert self.rows == want


def commander(jumps):
    return jumps.withColumn("commander", F.lit("me"))


def test_growing_journal_is_followed(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    path = folder / "Journal.1.log"
    path.write_text("\n".join(LINES[:3]) + "\n" + LINES[4][:10])
    nodes = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "system string, seq int")
    seen = Seen()
    followed = Tracker(advance(commander(stream_jumps(spark, str(folder))), nodes), seen, str(tmp_path / "c"), 0.2).start()
    seen.until([("A", 1)], followed)
    with path.open("a") as f:
        f.write(LINES[4][10:] + "\n" + LINES[5] + "\n")
    seen.until([("A", 1), ("B", 2)], followed)
    # stopped without clearing, it goes on where it ended and still knows how far it had come
    followed.stop(clear=False)
    assert not followed.tracking
    with path.open("a") as f:
        f.write(jump("A") + "\n" + jump("C") + "\n")
    followed.start()
    seen.until([("A", 1), ("B", 2), ("C", 3)], followed)
    followed.stop()
    assert not (tmp_path / "c").exists()


def test_files_of_a_journal_follow_one_another(spark, tmp_path):
    """A later file's small offsets come after an earlier file's large ones."""
    folder = tmp_path / "j"
    folder.mkdir()
    (folder / "Journal.1.log").write_text("".join(jump(s) + "\n" for s in ["X"] * 30 + ["A"]))
    (folder / "Journal.2.log").write_text("".join(jump(s) + "\n" for s in "AAB"))
    changes = track(commander(stream_jumps(spark, str(folder)))).select("commander", "system", "offset")
    seen = Seen()
    tracker = Tracker(changes, seen, str(tmp_path / "c"), 0.2).start()
    try:
        end = time.time() + 60
        while time.time() < end and len(seen.rows) < 3:
            time.sleep(0.1)
        time.sleep(0.5)
        assert [s for s, _ in seen.rows] == ["X", "A", "B"]
    finally:
        tracker.stop()


def test_tracking_begins_with_the_last_jump(spark, tmp_path):
    import os

    folder = tmp_path / "j"
    folder.mkdir()
    (folder / "Journal.1.log").write_text("".join(jump(s) + "\n" for s in "PQ"))
    newest = folder / "Journal.0.log"  # the newest by its time, not by its name
    newest.write_text("".join(jump(s) + "\n" for s in "AB") + '{"event":"Docked"}\n' * 3000)
    os.utime(folder / "Journal.1.log", (100, 100))
    assert readers.last_jump_of(spark, str(folder)).first()["StarSystem"] == "B"
    changes = track(commander(stream_jumps(spark, str(folder), "last")), sample="last").select("system", "offset")
    seen = Seen()
    tracker = Tracker(changes, seen, str(tmp_path / "c"), 0.2).start()
    try:
        end = time.time() + 60
        while time.time() < end and not seen.rows:
            time.sleep(0.1)
        with newest.open("a") as f:
            f.write("".join(jump(s) + "\n" for s in "BCD"))
        while time.time() < end and len(seen.rows) < 2:
            time.sleep(0.1)
        assert [s for s, _ in seen.rows] == ["B", "D"]
        # stopped and cleared, the same system counts as new
        tracker.stop()
        tracker.start()
        while time.time() < end and len(seen.rows) < 3:
            time.sleep(0.1)
        assert [s for s, _ in seen.rows] == ["B", "D", "D"]
    finally:
        tracker.stop()


def test_progress_is_kept_by_batch(spark, tmp_path):
    sink = persisted(str(tmp_path / "p"))
    rows = spark.createDataFrame([("me", "A", 1)], "commander string, system string, progress long")
    sink(rows, 0)
    sink(rows, 0)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    writers.store(rows, str(tmp_path / "v"))
    writers.clear(spark, str(tmp_path / "v"))
    writers.clear(spark, str(tmp_path / "v"))
    assert not (tmp_path / "v").exists()


# Imports

HTML = """<table><thead><tr><td>Refuel?</td><td>System Name</td><td>Distance (LY)</td><td>Neutron</td></tr></thead>
<tbody><tr><td>Yes</td><td><a href="/system/42"> A </a></td><td>12.5</td><td>No</td></tr>
<tr><td></td><td>B</td><td>1,234.5</td><td>Yes</td></tr></tbody></table><table><tbody><tr><td>no</td></tr></tbody></table>"""


def test_html_import(spark):
    rows = readers.imported_rows(spark.createDataFrame([(HTML,), (None,), ("<p>none</p>",)], "html string")).orderBy("seq")
    assert [tuple(r) for r in rows.collect()] == [(0, "A", 42, 12.5, True, False), (1, "B", None, 1.0, False, True)]
    by_name = spark.createDataFrame([("B", 1.0, 1.0, 1.0)], "name string, x double, y double, z double")
    by_id = spark.createDataFrame([(42, 2.0, 2.0, 2.0)], "id64 long, x double, y double, z double")
    assert sorted(r["x"] for r in journal.resolve_import(rows, by_name, by_id, strict=True).collect()) == [1.0, 2.0]
    with pytest.raises(Exception, match="no coordinates for B"):
        journal.resolve_import(rows, by_name.limit(0), by_id, strict=True).collect()
    df = spark.createDataFrame([("1,234.5",), ("abc",), (" -3e2x",), (".5",), ("",)], "s string")
    assert [r[0] for r in df.select(parse_float(F.col("s"))).collect()] == [1.0, None, -300.0, 0.5, None]


def test_stored_routes(spark):
    node = {"system": {"name": "A", "coords": {"x": 1, "y": 2, "z": 3}}, "distance": 1.5, "refuel": True, "isNeutron": False}
    lacking = {k: v for k, v in node.items() if k != "refuel"}
    values = [json.dumps({"nodes": n, "progress": p}) for n, p in (([node], 1), ([lacking], 1), ([node], -1), ([node], 1.5))] + ["{broken", None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", readers.stored_route(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r["s"] is not None for r in got] == [True, False, False, False, False, False] and got[0]["s"]["progress"] == 1


def test_lookup_prefers_local_and_the_last(spark):
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    local = spark.createDataFrame([("A", 1.0, 1.0, 1.0, 0)], "name string, x float, y float, z float, pos int")
    ext = spark.createDataFrame([("A", 5.0, 5.0, 5.0, 0), ("B", 1.0, 1.0, 1.0, 0), ("B", 1000.0, 2000.0, 3000.0, 1)], "name string, x float, y float, z float, pos int")
    got = {r["name"]: (r["x"], r["source"]) for r in journal.lookup(wanted, local, ext).collect()}
    assert got == {"A": (1.0, "local"), "B": (-1.0, "external"), "C": (None, None)}


# Engine


def test_engine(spark, tmp_path):
    named = [("Sol", 0), ("Alpha Centauri", 0.2), ("Barnard's Star", 0.4), ("Wolf 359", -0.1)]
    e = Engine(spark)
    assert e.suggest_words("So") == []
    with pytest.raises(NotLoaded):
        e.get_star_from_coords(0, 0, 0)
    e.set_stars(e.with_ids(spark.createDataFrame([(n, float(x), 0.0, 0.0) for n, x in named], "name string, x float, y float, z float")))
    e.save(str(tmp_path / "stars"))
    e = Engine(spark).load(str(tmp_path / "stars"))
    plan = names.suggest_prefix(e.index(), "So", 9)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(fold,so)" in plan
    assert e.get_name(e.get_star_id("Sol")) == "Sol" and e.get_star_id("sol") is None and e.get_name(99) is None
    assert e.get_star_from_coords(0.01, 0, 0) == "Sol" and e.get_coords_for_star("Sol") == {"x": 0, "y": 0, "z": 0} and e.get_coords_for_star("sol") is None
    assert e.autocomplete("s") == [] and e.autocomplete("so") == ["Sol"]
    assert [n["name"] for n in e.route_by_name("Sol", "Barnard's Star")] == ["Sol", "Alpha Centauri", "Barnard's Star"]
    assert e.find_star_near_ray((0.3, 1, 0), (0.1, -1, 0), 0.01)["name"] == "Barnard's Star"
    assert e.pick(None, (-1, 0, 0), (1, 0, 0), math.pi / 3, 1000) in dict(named)
    ext = spark.createDataFrame([("Far", -400.0, 0.0, 0.0, 0)], "name string, x float, y float, z float, pos int")
    assert e.route_by_name("Sol", "Far", ext)[-1]["name"] == "Barnard's Star"
    with pytest.raises(LookupError):
        e.route_by_name("Sol", "Nowhere")
    with pytest.raises(ValueError):
        e.route_by_name(" ", "Sol")


def test_command_line(spark, tmp_path, capsys):
    from waymark.__main__ import main

    systems = [{"name": n, "coords": {"x": 1000.0 * i, "y": 0.0, "z": 0.0}, "bodies": []} for i, n in enumerate(["Sol", "Solati", "Colonia"])]
    (tmp_path / "dump.json").write_text("[\n" + ",\n".join(map(json.dumps, systems)) + "\n]\n")
    main(["parse", str(tmp_path / "dump.json"), str(tmp_path / "kept")], spark)
    main(["build", str(tmp_path / "kept"), str(tmp_path / "catalog"), "--array", str(tmp_path / "stars.bin")], spark)
    assert len((tmp_path / "stars.bin").read_bytes()) == 36
    capsys.readouterr()
    main(["analyze", str(tmp_path / "catalog"), "sol", "Sol"], spark)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == {"query": "sol", "found": False, "suggestions": ["Sol", "Solati"]} and lines[1]["found"] and lines[2]["names"] == 3


# Every query


def test_entry_and_queries(spark, sf):
    assert __spark_entry__.entry(spark).count() == 10
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 45


@pytest.mark.parametrize("name", sorted(__import__("waymark.queries", fromlist=["SQL"]).SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)

    def norm(v):
        return round(v, 9) if isinstance(v, float) else [norm(x) for x in v] if isinstance(v, list) else v

    got = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(str([norm(v) for v in r]) for r in cur.fetchall())


def test_materialize_cuts_lineage(spark):
    df = materialize(spark.range(5).withColumn("v", F.col("id") * 2), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_distance_is_single_precision(spark):
    rng = np.random.default_rng(0)
    p = np.float32(rng.uniform(-50, 50, (200, 6)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in p], "ax float, ay float, az float, bx float, by float, bz float")
    d = p[:, :3] - p[:, 3:]
    want = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
    got = np.array([r[0] for r in df.select(dist("a", "b")).collect()], np.float32)
    assert (np.sort(got) == np.sort(want)).all()
