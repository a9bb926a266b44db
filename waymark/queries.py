"""The engine's queries over the driver's tables, each with SQL that gives the same rows where SQL can say it.

Stars are the rows of ``embeddings``, at their first three dimensions; names
are those of parts and customers; raw systems are orders, whose lines are
their bodies; journal events are ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geometry, text
from waymark.functions.ranking import with_row_index
from waymark.operators import catalog, journal, names, route, spatial
from waymark.plans.engine import Engine
from waymark.sources import readers, writers
from waymark.sources.tables import fresh_path, materialize

P, R, SMALL = (0.05, -0.1, 0.1), 0.15, 0.10
RAY, TOLERANCE = ((-0.5, 0.02, 0.01), (1.0, 0.05, -0.02)), 0.4


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stars(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("star_id"), F.concat(F.lit("Star "), F.col("vec_id").cast("string")).alias("name"), *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def probes(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    at = [((k % 5) - 2) * F.lit(0.1), ((k % 3) - 1) * F.lit(0.1), ((k % 7) - 3) * F.lit(0.05)]
    return _t(spark, d, "nation").select(k.cast("long").alias("probe_id"), *[geometry.f32(v).alias(c) for v, c in zip(at, "xyz", strict=True)])


def all_names(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(_t(spark, d, "customer").select(F.col("c_name").alias("name"))).distinct()


def raw_systems(spark, d) -> DataFrame:
    """Orders as raw systems: line_no, name, coords in light-years, bodies in order of their lines."""
    sub = F.when(F.col("l_returnflag") == "A", "Neutron Star").when(F.col("l_returnflag") == "N", "K (Yellow-Orange) Star").otherwise("White Dwarf")
    body = F.struct(sub.alias("subType"), (F.col("l_quantity") * 90).cast("float").alias("distanceToArrival"), (F.col("l_linenumber") <= 2).alias("mainStar"), (F.col("l_suppkey") % 50 - 48).cast("long").alias("population"))
    own = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", body.alias("b")))).alias("s"))
    own = own.select("line_no", F.transform("s", lambda s: s["b"]).alias("bodies"))
    k = F.col("o_orderkey")
    at = [((k * 37) % 4001 - 2000).cast("float"), ((k * 53) % 6007 - 3000).cast("float"), ((k * 71) % 8009 - 4000).cast("float")]
    o = _t(spark, d, "orders").select(k.alias("line_no"), F.concat(F.lit("Order"), F.when(k % 10 == 0, " ").otherwise("-"), (k % 5000).cast("string")).alias("name"), F.struct(*[v.alias(c) for v, c in zip(at, "xyz", strict=True)]).alias("coords"))
    return o.join(own, "line_no", "left").withColumn("bodies", F.coalesce("bodies", F.expr("array()").cast(own.schema["bodies"].dataType)))


def _double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


_S = "(SELECT vec_id AS star_id, 'Star ' || vec_id AS name, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings)"
_PROBES = """(SELECT CAST(n_nationkey AS BIGINT) AS probe_id, CAST(((n_nationkey % 5) - 2) * CAST(0.1 AS DOUBLE) AS FLOAT) AS x,
 CAST(((n_nationkey % 3) - 1) * CAST(0.1 AS DOUBLE) AS FLOAT) AS y, CAST(((n_nationkey % 7) - 3) * CAST(0.05 AS DOUBLE) AS FLOAT) AS z FROM nation)"""
_NAMES = "(SELECT p_name AS name FROM part UNION SELECT c_name FROM customer)"
_RAW = """body AS (SELECT l_orderkey AS line_no, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, CASE l_returnflag WHEN 'A' THEN 'Neutron Star' WHEN 'N' THEN 'K (Yellow-Orange) Star' ELSE 'White Dwarf' END AS sub,
  CAST(l_quantity * 90 AS FLOAT) AS dist, l_linenumber <= 2 AS main, l_suppkey % 50 - 48 AS pop FROM lineitem),
last AS (SELECT line_no, sub FROM (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY ln DESC, pk DESC, sk DESC, q DESC) AS k FROM body WHERE main) WHERE k = 1),
agg AS (SELECT line_no, bool_or(sub = 'Neutron Star' AND dist <= 3000) AS near, bool_or(pop > 0) AS people FROM body GROUP BY line_no),
folded AS (SELECT o_orderkey AS line_no, 'Order' || CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE '-' END || (o_orderkey % 5000) AS name,
  CAST((o_orderkey * 37) % 4001 - 2000 AS FLOAT) AS x, CAST((o_orderkey * 53) % 6007 - 3000 AS FLOAT) AS y, CAST((o_orderkey * 71) % 8009 - 4000 AS FLOAT) AS z,
  coalesce(last.sub = 'Neutron Star', false) AS main_is_neutron, coalesce(left(last.sub, 1) IN ('K', 'G', 'B', 'F', 'O', 'A', 'M'), false) AS refuelable,
  coalesce(near, false) AS nearby_neutron, coalesce(people, false) AS has_population
  FROM orders LEFT JOIN last ON last.line_no = o_orderkey LEFT JOIN agg ON agg.line_no = o_orderkey),
zone AS (SELECT line_no, (row_number() OVER (ORDER BY line_no) - 1) % 256 = 0 AS chosen FROM folded WHERE abs(x) <= 800 OR abs(y) <= 800 OR abs(z) <= 800),
kept AS (SELECT folded.* FROM folded LEFT JOIN zone USING (line_no) WHERE main_is_neutron OR (nearby_neutron AND refuelable) OR has_population OR name NOT LIKE '%-%' OR coalesce(chosen, false))"""
_RADIX = f"""k AS (SELECT DISTINCT name FROM {_NAMES} WHERE name <> ''),
pre AS (SELECT name, i, substr(name, 1, i) AS p, substr(name, i + 1, 1) AS nb FROM (SELECT name, unnest(generate_series(1, length(name))) AS i FROM k)),
node AS (SELECT p, bool_or(nb = '') AS is_terminal FROM pre GROUP BY p HAVING count(DISTINCT CASE WHEN nb <> '' THEN nb END) >= 2 OR bool_or(nb = '')),
nd AS (SELECT pre.name AS name, pre.i AS i, pre.p AS p, row_number() OVER (PARTITION BY pre.name ORDER BY pre.i) AS depth, coalesce(lag(pre.p) OVER (PARTITION BY pre.name ORDER BY pre.i), '') AS parent FROM pre JOIN node ON pre.p = node.p),
rank AS (SELECT name, max(depth) AS radix_depth FROM nd GROUP BY name),
star AS (SELECT name, radix_depth, row_number() OVER (ORDER BY radix_depth, name) - 1 AS star_id FROM rank),
tree AS (SELECT DISTINCT nd.p AS node, depth, parent, substr(nd.p, length(parent) + 1) AS label, is_terminal FROM nd JOIN node ON nd.p = node.p)"""


def _d2(a: str, b: str | tuple) -> str:
    parts = [f"({a}{c} - {b}{c})" if isinstance(b, str) else f"({a}{c} - CAST({b[i]!r} AS FLOAT))" for i, c in enumerate("xyz")]
    return " + ".join(f"{p} * {p}" for p in parts)


def _r2(r: float) -> str:
    return f"CAST({r} AS FLOAT) * CAST({r} AS FLOAT)"


def _ray_sql(rows: str) -> str:
    (o, d), size = RAY, sum(v * v for v in RAY[1]) ** 0.5
    u = [v / size for v in d]
    rel = [f"(CAST({c} AS DOUBLE) - CAST({float(o[i])!r} AS DOUBLE))" for i, c in enumerate("xyz")]
    t = " + ".join(f"{rel[i]} * CAST({u[i]!r} AS DOUBLE)" for i in range(3))
    off = [f"({rel[i]} - t * CAST({u[i]!r} AS DOUBLE))" for i in range(3)]
    return f"(SELECT *, ({off[0]} * {off[0]} + {off[1]} * {off[1]} + {off[2]} * {off[2]}) / (t * t) AS ang2 FROM (SELECT *, {t} AS t FROM {rows}) WHERE t > 0 AND t <= 240)"


Q: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# points


@_query(f"SELECT star_id, CAST(CAST(-(x / CAST(1000 AS DOUBLE)) AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS z FROM {_S}")
def coord_transform(spark, d):
    return _double(stars(spark, d).select("star_id", *geometry.to_scene(F.col("x"), F.col("y"), F.col("z"))), "x", "y", "z")


@_query(f"SELECT a.star_id AS star_id, CAST(CAST(sqrt({_d2('a.', 'b.')}) AS FLOAT) AS DOUBLE) AS dist FROM {_S} a JOIN {_S} b ON b.star_id = a.star_id + 1")
def pair_distance(spark, d):
    a = stars(spark, d)
    b = a.select((F.col("star_id") - 1).alias("star_id"), *[F.col(c).alias(f"n_{c}") for c in "xyz"])
    return a.join(b, "star_id").select("star_id", geometry.dist("", "n_").cast("double").alias("dist"))


@_query(f"SELECT star_id, CAST({_d2('', P)} AS DOUBLE) AS d2 FROM {_S} WHERE {_d2('', P)} <= {_r2(R)}")
def within_radius(spark, d):
    return _double(spatial.within_radius(stars(spark, d), P, R).select("star_id", "d2"), "d2")


@_query(f"SELECT star_id, name, CAST({_d2('', P)} AS DOUBLE) AS d2 FROM {_S} ORDER BY {_d2('', P)}, star_id LIMIT 10")
def nearest(spark, d):
    return _double(spatial.nearest(stars(spark, d), P, 10).select("star_id", "name", "d2"), "d2")


@_query(f"SELECT probe_id, star_id, CAST(d2 AS DOUBLE) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d2, star_id) AS k FROM (SELECT p.probe_id AS probe_id, s.star_id AS star_id, {_d2('p.', 's.')} AS d2 FROM {_PROBES} p, {_S} s)) WHERE k = 1")
def nearest_join(spark, d):
    return _double(spatial.nearest_join(probes(spark, d), stars(spark, d).select("star_id", "x", "y", "z"), 0.05), "d2")


@_query(f"SELECT a.star_id AS a, b.star_id AS b, CAST({_d2('a.', 'b.')} AS DOUBLE) AS d2 FROM {_S} a JOIN {_S} b ON a.star_id < b.star_id AND {_d2('a.', 'b.')} <= {_r2(SMALL)}")
def radius_join(spark, d):
    s = stars(spark, d).select("star_id", "x", "y", "z")
    pairs = spatial.range_join(s, s, SMALL).where("l_star_id < r_star_id")
    return _double(pairs.select(F.col("l_star_id").alias("a"), F.col("r_star_id").alias("b"), "d2"), "d2")


@_query(f"SELECT probe_id, star_id, CAST(d2 AS DOUBLE) AS d2, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d2, star_id) AS rank FROM (SELECT p.probe_id AS probe_id, s.star_id AS star_id, {_d2('p.', 's.')} AS d2 FROM {_PROBES} p, {_S} s) WHERE d2 <= {_r2(R)}) WHERE rank <= 8")
def radius_capped(spark, d):
    return _double(spatial.radius_capped(probes(spark, d), stars(spark, d).select("star_id", "x", "y", "z"), R, 8), "d2")


@_query(f"SELECT n, CAST(min_x AS DOUBLE) AS min_x, CAST(min_y AS DOUBLE) AS min_y, CAST(min_z AS DOUBLE) AS min_z, CAST(max_x AS DOUBLE) AS max_x, CAST(max_y AS DOUBLE) AS max_y, CAST(max_z AS DOUBLE) AS max_z, CASE WHEN max_z - min_z >= greatest(max_x - min_x, max_y - min_y) THEN 'z' WHEN max_y - min_y >= max_x - min_x THEN 'y' ELSE 'x' END AS widest FROM (SELECT count(*) AS n, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM {_S})")
def bbox(spark, d):
    return _double(spatial.bbox(stars(spark, d)), *[f"{m}_{c}" for m in ("min", "max") for c in "xyz"])


@_query(f"SELECT star_id, name, round(t, 9) AS t, round(ang2, 9) AS ang2 FROM {_ray_sql(_S)} WHERE ang2 <= {TOLERANCE * TOLERANCE!r} ORDER BY ang2, star_id LIMIT 1")
def ray_pick(spark, d):
    hit = spatial.ray_pick(stars(spark, d), *RAY, TOLERANCE)
    return hit.select("star_id", "name", F.round("t", 9).alias("t"), F.round("ang2", 9).alias("ang2"))


@_query(f"SELECT star_id, name FROM {_S} ORDER BY {_d2('', P)}, star_id LIMIT 1")
def point_to_name(spark, d):
    return spatial.nearest(stars(spark, d), P).select("star_id", "name")


def _partition_sql(depth: int) -> str:
    ctes = [f"l0 AS (SELECT star_id, x, y, z, 0 AS part FROM {_S})"]
    for i in range(depth):
        ctes.append(f"m{i} AS (SELECT part, CASE WHEN wz >= greatest(wx, wy) THEN 'z' WHEN wy >= wx THEN 'y' ELSE 'x' END AS axis, mx, my, mz FROM (SELECT part, max(x) - min(x) AS wx, max(y) - min(y) AS wy, max(z) - min(z) AS wz, quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my, quantile_disc(z, 0.5) AS mz FROM l{i} GROUP BY part))")
        ctes.append(f"l{i + 1} AS (SELECT star_id, x, y, z, l{i}.part * 2 + CASE WHEN CASE axis WHEN 'z' THEN z > mz WHEN 'y' THEN y > my ELSE x > mx END THEN 1 ELSE 0 END AS part FROM l{i} JOIN m{i} ON l{i}.part = m{i}.part)")
    return "WITH " + ", ".join(ctes) + f" SELECT star_id, part FROM l{depth}"


@_query(_partition_sql(3))
def spatial_partition(spark, d):
    return spatial.spatial_partition(stars(spark, d), 3).select("star_id", "part")


@_query(f"SELECT label, list(x ORDER BY star_id) AS xs, CAST(count(*) * 3 AS INTEGER) AS numbers FROM (SELECT label, vec_id AS star_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) GROUP BY label")
def flat_arrays(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label").withColumnRenamed("vec_id", "star_id")
    flat = writers.flatten_coords(stars(spark, d).join(e, "star_id"), "label")
    return flat.select("label", F.transform(F.sequence(F.lit(0), F.floor(F.size("coords") / 3).cast("int") - 1), lambda i: F.get("coords", i * 3).cast("double")).alias("xs"), F.size("coords").alias("numbers"))


# names


@_query(f"WITH {_RADIX} SELECT name, radix_depth, star_id FROM star")
def trie_rank(spark, d):
    return names.ranked(all_names(spark, d)).select("name", F.col("radix_depth").cast("long").alias("radix_depth"), "star_id")


@_query(f"WITH {_RADIX} SELECT name, star_id FROM star WHERE name = 'Customer#000000042'")
def exact_find(spark, d):
    return names.ranked(all_names(spark, d)).where(F.col("name") == "Customer#000000042").select("name", "star_id")


@_query(f"WITH {_RADIX} SELECT star_id, name FROM star WHERE star_id IN (0, 7, 63, 100)")
def id_to_name(spark, d):
    return names.ranked(all_names(spark, d)).where(F.col("star_id").isin(0, 7, 63, 100)).select("star_id", "name")


@_query(f"SELECT name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {_S} WHERE name = 'Star 42'")
def name_to_coords(spark, d):
    found = Engine(spark).set_stars(stars(spark, d)).get_coords_for_star("Star 42")
    return spark.createDataFrame([("Star 42", *map(float, found.values()))] if found else [], "name string, x double, y double, z double")


@_query(f"SELECT name, CAST(row_number() OVER (ORDER BY lower(name), name) AS INTEGER) AS rank FROM (SELECT DISTINCT name FROM {_NAMES} WHERE starts_with(lower(name), 'customer#0000001')) ORDER BY rank LIMIT 10")
def suggest_lex(spark, d):
    return names.suggest_lex(all_names(spark, d), "CUSTOMER#0000001", 10)


@_query(f"SELECT min(name) AS name, (SELECT count(*) FROM {_NAMES} WHERE lower(name) < 'customer#000000042') AS place FROM {_NAMES} WHERE lower(name) = 'customer#000000042'")
def find_ci(spark, d):
    return names.find_ci(all_names(spark, d), "CUSTOMER#000000042")


@_query(f"""WITH {_RADIX}, own AS (SELECT name, max(depth) AS depth FROM nd WHERE starts_with(lower(name), 'cust') GROUP BY name),
s AS (SELECT own.name AS name, own.depth AS depth, min(struct_pack(i := nd.i, p := nd.p, d := nd.depth)) AS st FROM own JOIN nd ON nd.name = own.name AND nd.i >= 4 GROUP BY ALL)
SELECT name, CAST(row_number() OVER (ORDER BY depth - st.d, st.d, st.p, name) AS INTEGER) AS rank FROM s ORDER BY rank LIMIT 25""")
def suggest_prefix(spark, d):
    return names.suggest_prefix(all_names(spark, d), "CUst", 25)


@_query(f"WITH {_RADIX} SELECT node, CAST(depth AS INTEGER) AS depth, parent, label, is_terminal FROM tree")
def radix_nodes(spark, d):
    return names.radix_nodes(all_names(spark, d))


@_query(f"WITH {_RADIX} SELECT label, count(*) AS n FROM tree GROUP BY label ORDER BY n DESC, label LIMIT 20")
def label_topk(spark, d):
    return names.label_counts(all_names(spark, d), 20)


@_query("SELECT n_name AS a, r_name AS b, CAST(list_max(list_filter(generate_series(0, least(length(n_name), length(r_name))), lambda k: right(n_name, k) = left(r_name, k))) AS INTEGER) AS overlap FROM nation JOIN region ON n_regionkey = r_regionkey")
def label_overlap(spark, d):
    pairs = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return names.overlaps(pairs.select(F.col("n_name").alias("a"), F.col("r_name").alias("b")))


@_query(f"WITH {_RADIX}, l AS (SELECT DISTINCT label FROM tree) SELECT a.label AS label, count(*) AS hosts FROM l a JOIN l b ON a.label <> b.label AND contains(b.label, a.label) GROUP BY a.label")
def label_substrings(spark, d):
    return names.contained_labels(all_names(spark, d))


@_query(f"""WITH {_RADIX} SELECT *, CAST(ceil((2 * nodes + 3) / 64.0) * 8 + 3 * ceil((nodes + 1) / 64.0) * 8 + labels_8 + 2 * labels_16 + 4 * labels_32 + 4 * least(labels, 65536) + distinct_bytes AS BIGINT) AS size FROM (SELECT count(*) AS nodes, count(*) FILTER (is_terminal) AS names, CAST(sum(length(label)) AS BIGINT) AS label_bytes, CAST(max(depth) AS INTEGER) AS deepest, (SELECT count(DISTINCT label) FROM tree) AS labels, (SELECT CAST(sum(length(label)) AS BIGINT) FROM (SELECT DISTINCT label FROM tree)) AS distinct_bytes, (SELECT max(n) FROM (SELECT count(*) AS n FROM tree GROUP BY label)) AS most_used,
 count(*) FILTER (number < 256) AS labels_8, count(*) FILTER (number BETWEEN 256 AND 65535) AS labels_16, count(*) FILTER (number > 65535) AS labels_32
 FROM tree JOIN (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS number FROM (SELECT label, count(*) AS n FROM tree GROUP BY label)) USING (label))""")
def catalog_stats(spark, d):
    return names.catalog_stats(all_names(spark, d))


@_query(f"WITH {_RADIX}, pal AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS number FROM (SELECT label, count(*) AS n FROM tree GROUP BY label)) SELECT node, label, CASE WHEN number < 300 THEN CAST(number AS INTEGER) END AS number, CAST(CASE WHEN number < 256 THEN 8 WHEN number < 300 THEN 16 ELSE 32 END AS INTEGER) AS bits FROM tree JOIN pal USING (label)")
def label_palette(spark, d):
    return names.encoded(names.radix_nodes(all_names(spark, d)), 300).select("node", "label", "number", "bits")


@_query(f"WITH {_RADIX} SELECT node, label FROM tree WHERE parent = (SELECT node FROM tree WHERE parent = '' ORDER BY label LIMIT 1)")
def node_children(spark, d):
    nodes = materialize(names.radix_nodes(all_names(spark, d)), "nodes")
    top = names.children(nodes, "").first()
    return names.children(nodes, top["node"]).select("node", "label")


@_query("SELECT n_nationkey, 'systemName[]=' || replace(n_name, ' ', '%20') || '&systemName[]=' || replace(n_name, ' ', '%20') || '%20%2B%26%3D(%C3%A9)' AS query FROM nation")
def url_queries(spark, d):
    asked = F.array("n_name", F.concat("n_name", F.lit(" +&=(é)")))
    return _t(spark, d, "nation").select("n_nationkey", text.systems_query(asked).alias("query"))


# catalog build


@_query(f"WITH {_RAW} SELECT line_no, name, main_is_neutron, refuelable, nearby_neutron, has_population FROM folded")
def etl_bodies(spark, d):
    return catalog.fold_bodies(raw_systems(spark, d)).drop("coords")


@_query(f"WITH {_RAW} SELECT line_no, name, refuelable, nearby_neutron AS neutron_star FROM kept")
def etl_filter(spark, d):
    return catalog.keep(catalog.fold_bodies(raw_systems(spark, d))).drop("coords")


@_query(f"WITH {_RAW} SELECT name, CAST(CAST(-(x / CAST(1000 AS DOUBLE)) AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS z, nearby_neutron AS is_neutron_star, true AS searchable FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY line_no) AS k FROM kept) WHERE k = 1")
def etl_catalog(spark, d):
    return _double(catalog.build(raw_systems(spark, d)), "x", "y", "z")


@_query(f"WITH {_RAW} SELECT line_no + 0 AS line_no, name, refuelable, nearby_neutron FROM (SELECT row_number() OVER (ORDER BY line_no) AS line_no, name, refuelable, nearby_neutron FROM folded)")
def dump_scan(spark, d):
    """Raw systems written as a dump and read back: fields, bodies, and lines by their place."""
    raw = raw_systems(spark, d)
    path = fresh_path(spark, "dump")
    lines = raw.select("line_no", F.concat(F.to_json(F.struct("name", "coords", "bodies")), F.lit(",")).alias("value"))
    ends = spark.createDataFrame([(-1, "["), (1 << 62, "]"), ((1 << 62) + 1, "behind the end")], "line_no long, value string")
    lines.unionByName(ends).orderBy("line_no").coalesce(1).select("value").write.text(path)
    back = readers.dump_systems(readers.numbered_lines(spark, path))
    return catalog.fold_bodies(back).select("line_no", "name", "refuelable", "nearby_neutron")


@_query(f"SELECT row_number() OVER (ORDER BY star_id) - 1 AS star_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {_S}")
def star_array(spark, d):
    """Stars written as one flat array and read back by their places."""
    path = fresh_path(spark, "stars") + ".bin"
    writers.write_star_array(stars(spark, d), path)
    return _double(readers.star_array(spark, path), "x", "y", "z")


@_query(f"SELECT label, star_id AS seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS star_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings)")
def unflat_arrays(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("star_id"), "label")
    back = writers.unflatten_coords(writers.flatten_coords(stars(spark, d).join(e, "star_id"), "label"), "label")
    return _double(back.withColumn("seq", F.col("seq").cast("long")), "x", "y", "z")


@_query("SELECT p_name AS name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def dedup_first(spark, d):
    return catalog.first_by_name(_t(spark, d, "part").select(F.col("p_name").alias("name"), "p_partkey", "p_brand"), "p_partkey")


@_query(f"WITH {_RAW} SELECT line_no, chosen FROM zone")
def deadzone_sample(spark, d):
    return catalog.deadzone_sample(raw_systems(spark, d).select("line_no", "coords"))


# routes


@_query(f"SELECT DISTINCT b.star_id AS star_id FROM {_S} a JOIN {_S} b ON {_d2('a.', 'b.')} <= {_r2(SMALL)} WHERE a.star_id IN (SELECT star_id FROM {_S} WHERE {_d2('', P)} <= {_r2(R)}) AND b.star_id NOT IN (SELECT star_id FROM {_S} WHERE {_d2('', P)} <= {_r2(R)})")
def frontier_anti(spark, d):
    s = stars(spark, d).select("star_id", "x", "y", "z")
    seen = spatial.within_radius(s, P, R).drop("d2")
    pairs = spatial.range_join(seen, s, SMALL)
    found = pairs.select(F.col("r_star_id").alias("star_id"), *[F.col(f"r_{c}").alias(c) for c in "xyz"], F.col("l_star_id").alias("parent"), F.col("l_star_id").alias("parent_rank"))
    return route.unseen(found, seen).select("star_id")


@_query(f"SELECT star_id, CAST(CAST(sqrt({_d2('', (0.2, 0.2, 0.2))}) AS FLOAT) AS DOUBLE) AS to_end FROM {_S} ORDER BY to_end, star_id LIMIT (SELECT least(64, count(*) - 1) FROM {_S})")
def beam_topk(spark, d):
    s = stars(spark, d)
    return _double(route.beam(s, (0.2, 0.2, 0.2), 64, s.count()).select("star_id", "to_end"), "to_end")


@_query(f"WITH RECURSIVE s AS (SELECT * FROM {_S}), e AS (SELECT a.star_id AS a, b.star_id AS b FROM s a JOIN s b ON a.star_id <> b.star_id AND {_d2('a.', 'b.')} <= {_r2(SMALL)}), r(star_id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.star_id WHERE depth < 3) SELECT star_id, min(depth) AS depth FROM r GROUP BY star_id")
def bfs_hops(spark, d):
    return route.bfs(stars(spark, d).select("star_id", "x", "y", "z"), 0, SMALL, 3)


@_query("WITH RECURSIVE l AS (SELECT CAST(c_custkey AS BIGINT) AS child, CASE WHEN c_custkey > 1 THEN CAST(c_custkey // 2 AS BIGINT) END AS parent FROM customer), up(node, step) AS (SELECT (SELECT max(child) FROM l), 0 UNION ALL SELECT parent, step + 1 FROM up JOIN l ON l.child = up.node WHERE parent IS NOT NULL) SELECT node, step FROM up")
def path_reconstruct(spark, d):
    k = F.col("c_custkey").cast("long")
    links = _t(spark, d, "customer").select(k.alias("child"), F.when(k > 1, F.expr("c_custkey div 2")).alias("parent"))
    return route.reconstruct(spark, links, links.agg(F.max("child")).first()[0])


def _ends(s: DataFrame) -> tuple[tuple, tuple]:
    a, b = s.where("star_id = 0").first(), spatial.nearest(s, (0.25, 0.1, 0.1)).first()
    return tuple(tuple(r[c] for c in "xyz") for r in (a, b))


@_query(f"SELECT star_id, CAST(to_end AS DOUBLE) AS to_end, CAST(min(to_end) OVER (ORDER BY star_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS closest FROM (SELECT star_id, CAST(sqrt({_d2('', (0.2, 0.2, 0.2))}) AS FLOAT) AS to_end FROM {_S} WHERE {_d2('', P)} <= {_r2(R)})")
def closest_so_far(spark, d):
    ball = spatial.within_radius(stars(spark, d), P, R).select("star_id", geometry.dist("", (0.2, 0.2, 0.2)).alias("to_end"))
    return _double(route.closest_so_far(ball, ["star_id"]), "to_end", "closest")


@_query(f"WITH RECURSIVE s AS (SELECT * FROM {_S}), e AS (SELECT a.star_id AS a, b.star_id AS b FROM s a JOIN s b ON a.star_id <> b.star_id AND {_d2('a.', 'b.')} <= {_r2(SMALL)}), r(star_id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.star_id WHERE depth < 20), t AS (SELECT star_id AS goal FROM s ORDER BY {_d2('', (0.25, 0.1, 0.1))}, star_id LIMIT 1) SELECT coalesce((SELECT min(depth) FROM r JOIN t ON star_id = goal), -1) AS jumps")
def route_jumps(spark, d):
    """Jumps of a route whose beam holds every star, so that it is a shortest one; -1 if there is none."""
    s = stars(spark, d)
    try:
        jumps = len(route.find_route(s, *_ends(s), reach=SMALL, width=1 << 30, drop_worst=False, max_depth=20)) - 1
    except route.RouteNotFound:
        jumps = -1
    return spark.createDataFrame([(jumps,)], "jumps int")


@_query()
def route_search(spark, d):
    s = stars(spark, d)
    try:
        ids = route.find_route(s, *_ends(s), reach=SMALL)
    except route.RouteNotFound:
        ids = []
    return spark.createDataFrame(list(enumerate(ids)), "seq int, star_id long")


@_query()
def route_by_name(spark, d):
    e = Engine(spark).set_stars(stars(spark, d))
    try:
        nodes = e.route_by_name("Star 0", "Star 1", reach=0.12)
    except route.RouteNotFound:
        nodes = []
    return spark.createDataFrame([(i, n["name"], *map(float, n["coords"].values())) for i, n in enumerate(nodes)], "seq int, name string, x double, y double, z double")


def _routes(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("star_id"), "label")
    return stars(spark, d).join(e, "star_id").withColumn("seq", F.col("star_id"))


_HOPS = f"(SELECT label, vec_id AS seq, CAST(sqrt({_d2('', 'p_')}) AS FLOAT) AS hop FROM (SELECT label, vec_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z, lag(embedding[1]) OVER w AS p_x, lag(embedding[2]) OVER w AS p_y, lag(embedding[3]) OVER w AS p_z FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)))"


@_query(f"SELECT label, seq, CAST(hop AS DOUBLE) AS hop FROM {_HOPS}")
def route_hops(spark, d):
    return _double(route.hops(_routes(spark, d), "label").select("label", "seq", "hop"), "hop")


@_query(f"SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY seq) AS INTEGER) AS row, 'Star ' || seq AS name, round(CAST(coalesce(hop, 0) AS DOUBLE) * 1000, 2) AS light_years, row_number() OVER (PARTITION BY label ORDER BY seq) <= 3 AS visited FROM {_HOPS}")
def route_list(spark, d):
    return route.display(_routes(spark, d), "label", 3)


@_query(f"SELECT star_id, name, round(t, 9) AS t FROM {_ray_sql(_S)} WHERE ang2 * t * t <= CAST(0.1 AS DOUBLE) * 0.1 ORDER BY t, star_id LIMIT 1")
def route_pick(spark, d):
    return spatial.route_pick(stars(spark, d), *RAY, 0.1).select("star_id", "name", F.round("t", 9).alias("t"))


@_query("WITH n(system, seq) AS (VALUES ('view', 0), ('click', 1), ('signup', 2), ('click', 3), ('purchase', 4)), f AS (SELECT system, min(seq) AS first FROM n GROUP BY system) SELECT event_id, coalesce(max(first + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS progress FROM events LEFT JOIN f ON f.system = event_type")
def route_progress(spark, d):
    nodes = spark.createDataFrame([(s, i) for i, s in enumerate(["view", "click", "signup", "click", "purchase"])], "system string, seq int")
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("system"))
    return route.progress(e, nodes, "user_id", ["ts", "event_id"]).select("event_id", "progress")


# journal and imports


def _journal(spark, d) -> DataFrame:
    """Events as lines of a journal file, written to the shared folder and read by their places in it."""
    kind = F.when(F.col("event_type") == "error", "Docked").otherwise("FSDJump")
    k = F.from_json("props", "k long")["k"].cast("double")
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), kind.alias("event"), F.col("event_type").alias("StarSystem"), F.col("event_id").cast("long").alias("SystemAddress"), F.array(k * 1000, k * 2000, k * -3000).alias("StarPos")))
    path = fresh_path(spark, "journal")
    _t(spark, d, "events").orderBy("event_id").coalesce(1).select(line.alias("value")).write.text(f"{path}/Journal.1")
    return readers.numbered_lines(spark, f"{path}/Journal.1")


@_query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS line_no, event_type AS system, -CAST(json_extract(props, '$.k') AS DOUBLE) AS x, 2 * CAST(json_extract(props, '$.k') AS DOUBLE) AS y, -3 * CAST(json_extract(props, '$.k') AS DOUBLE) AS z FROM events QUALIFY event_type <> 'error'")
def journal_jumps(spark, d):
    jumps = journal.locations(readers.journal_jumps(_journal(spark, d)))
    return jumps.select(F.col("SystemAddress").alias("event_id"), "line_no", F.col("StarSystem").alias("system"), "x", "y", "z")


@_query("SELECT event_id, event_type AS system FROM events WHERE event_type <> 'error' ORDER BY event_id DESC LIMIT 1")
def journal_bootstrap(spark, d):
    path = fresh_path(spark, "journals")
    lines = _journal(spark, d).orderBy("line_no").coalesce(1).select("value")
    lines.limit(50).write.text(f"{path}/old")
    lines.write.text(f"{path}/new")
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for number, name in enumerate(("old", "new")):
        part = next(f.getPath() for f in system.listStatus(hadoop.Path(f"{path}/{name}")) if f.getPath().getName().startswith("part-"))
        system.rename(part, hadoop.Path(f"{path}/Journal.{number}.log"))
        system.setTimes(hadoop.Path(f"{path}/Journal.{number}.log"), 1_000_000 * (number + 1), -1)
    last = readers.last_jump_of(spark, path)
    return last.select(F.col("SystemAddress").alias("event_id"), F.col("StarSystem").alias("system"))


@_query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def journal_changes(spark, d):
    return journal.changes(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@_query("SELECT user_id, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def journal_last(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return journal.last_jump(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@_query(f"SELECT name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM {_S}")
def json_scan(spark, d):
    line = F.format_string('{"name":"%s","coords":{"x":%s,"y":%s,"z":%s}},', "name", *[F.col(c).cast("string") for c in "xyz"])
    return _double(stars(spark, d).select(readers.scan_line(line).alias("s")).select("s.*"), "x", "y", "z")


@_query(f"""WITH w AS (SELECT 'Star ' || c_custkey AS name FROM customer), l AS (SELECT name, x, y, z FROM {_S}),
e AS (SELECT 'Star ' || (s_suppkey + 400) AS name, CAST(-(CAST(s_suppkey AS FLOAT) / CAST(1000 AS DOUBLE)) AS FLOAT) AS x, CAST(CAST(s_suppkey AS FLOAT) / CAST(1000 AS DOUBLE) AS FLOAT) AS y, CAST(CAST(s_suppkey AS FLOAT) / CAST(1000 AS DOUBLE) AS FLOAT) AS z FROM supplier)
SELECT w.name AS name, CAST(CASE WHEN l.name IS NOT NULL THEN l.x ELSE e.x END AS DOUBLE) AS x, CAST(CASE WHEN l.name IS NOT NULL THEN l.y ELSE e.y END AS DOUBLE) AS y, CAST(CASE WHEN l.name IS NOT NULL THEN l.z ELSE e.z END AS DOUBLE) AS z, CASE WHEN l.name IS NOT NULL THEN 'local' WHEN e.name IS NOT NULL THEN 'external' END AS source FROM w LEFT JOIN l ON w.name = l.name LEFT JOIN e ON w.name = e.name""")
def lookup_fallback(spark, d):
    wanted = _t(spark, d, "customer").select(F.concat(F.lit("Star "), F.col("c_custkey").cast("string")).alias("name"))
    k = F.col("s_suppkey")
    ext = _t(spark, d, "supplier").select(F.concat(F.lit("Star "), (k + 400).cast("string")).alias("name"), *[k.cast("float").alias(c) for c in "xyz"], k.alias("pos"))
    return _double(journal.lookup(wanted, stars(spark, d).select("name", "x", "y", "z", F.col("star_id").alias("pos")), ext), "x", "y", "z")


@_query("SELECT n_name AS name, n_nationkey AS id64, coalesce(n.x, i.x) AS x FROM nation LEFT JOIN (SELECT r_name AS name, CAST(r_regionkey AS DOUBLE) AS x FROM region) n ON n.name = n_name LEFT JOIN (SELECT s_suppkey AS id64, s_acctbal AS x FROM supplier) i ON i.id64 = n_nationkey")
def import_resolve(spark, d):
    rows = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id64"))
    x = F.col("r_regionkey").cast("double")
    by_name = _t(spark, d, "region").select(F.col("r_name").alias("name"), x.alias("x"), x.alias("y"), x.alias("z"))
    by_id = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id64"), *[F.col("s_acctbal").alias(c) for c in "xyz"])
    return journal.resolve_import(rows, by_name, by_id).select("name", "id64", "x")


@_query("SELECT o_orderkey, o_orderkey % 5 < 3 AS valid, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 11 AS INTEGER) END AS progress FROM orders")
def route_validate(spark, d):
    k = F.col("o_orderkey")
    node = '{"system":{"name":"A","coords":{"x":1,"y":2.5,"z":-3}},"distance":1.5,"refuel":true,"isNeutron":false}'
    broken = '{"system":{"name":"A","coords":{"x":1,"y":2.5,"z":-3}},"distance":1.5,"isNeutron":false}'
    nodes = F.when(k % 5 == 3, broken).otherwise(node)
    progress = F.when(k % 5 == 4, "-1").otherwise((k % 11).cast("string"))
    stored = F.concat(F.lit('{"nodes":['), nodes, F.lit('],"progress":'), progress, F.lit("}"))
    out = _t(spark, d, "orders").select("o_orderkey", readers.stored_route(stored).alias("s"))
    return out.select("o_orderkey", F.col("s").isNotNull().alias("valid"), F.col("s.progress").alias("progress"))


@_query("SELECT n_nationkey, 0 AS seq, n_name AS name, n_nationkey AS id64, CAST(1 AS DOUBLE) AS distance, true AS refuel, false AS is_neutron FROM nation")
def html_table_rows(spark, d):
    head = "<table><thead><tr><td>Refuel?</td><td>System Name</td><td>Distance (LY)</td><td>Neutron</td></tr></thead><tbody>"
    row = F.concat(F.lit("<tr><td>Yes</td><td><a href='/system/"), F.col("n_nationkey").cast("string"), F.lit("'> "), F.col("n_name"), F.lit(" </a></td><td>1,234.5</td><td>No</td></tr>"))
    return readers.imported_rows(_t(spark, d, "nation").select("n_nationkey", F.concat(F.lit(head), row, F.lit("</tbody></table>")).alias("html")))


@_query("SELECT s_suppkey, round(48 * 1.05 * pow(1000 * least(5, s_suppkey % 32 + 1) * 4.0 / 1000, 1 / CAST(2.45 AS DOUBLE)) / (280 + s_suppkey % 32 + 1), 4) AS jump FROM supplier")
def jump_range(spark, d):
    fuel = (F.col("s_suppkey") % 32 + 1).cast("double")
    jump = geometry.jump_range(fuel, F.lit(4.0), opt_mass=48.0, boost=1.05, max_fuel=5.0, rating=1000.0, fuel_class=2.45, base_mass=280.0)
    return _t(spark, d, "supplier").select("s_suppkey", F.round(jump, 4).alias("jump"))


@_query("SELECT c_custkey, CAST(regexp_extract(CAST(c_acctbal AS VARCHAR), '^([+-]?[0-9]+)', 1) AS BIGINT) AS whole FROM customer")
def parse_numbers(spark, d):
    return _t(spark, d, "customer").select("c_custkey", text.parse_int(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("whole"))


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def row_index(spark, d):
    return with_row_index(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")
