"""Names: exact and prefix search in the order of a radix tree, without building one.

A radix node is a prefix that is a name or that at least two different bytes
follow.  ``star_id`` is a name's place in order of the depth of its node, then
its bytes; suggestions come in order of depth below the shortest node that
holds the query.

The nodes on the way to a name end where it parts from some other name.  In
order of bytes those are the running minima, on either side, of the prefix
lengths that neighbours have in common, so one pass over sorted names finds
them; no prefix is ever a key that many names share.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.ranking import with_row_index
from waymark.functions.text import ascii_fold, overlap
from waymark.sources.tables import materialize

#: Labels that have a number of 8 bits in a palette, and of 16 bits; other labels are told by 32 bits.
PALETTE_8, PALETTE_16 = 256, 65536


def _common(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b]))


def _descend(stack: list[int], common: int) -> None:
    """Running minima after one more neighbour: none is above what it has in common."""
    while stack and stack[-1] > common:
        stack.pop()
    if common and (not stack or stack[-1] < common):
        stack.append(common)


def _runs(batches):
    """Rows (part, name) in order: the names of each part, which one task holds."""
    part, held = None, []
    for b in batches:
        for p, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(name.encode("utf-8", "surrogatepass"))
    if held:
        yield part, held


def _edges(batches):
    """Of each part of the order: its first and last name, and the running minima at both (of names in the part alone)."""
    for part, some in _runs(batches):
        common = [_common(a, b) for a, b in zip(some, some[1:])]
        left, right = [], []
        for c in common:
            _descend(left, c)
        for c in reversed(common):
            _descend(right, c)
        columns = [pa.array([part], pa.int32()), pa.array([some[0]], pa.binary()), pa.array([some[-1]], pa.binary()), pa.array([min(common, default=-1)], pa.int32()), pa.array([left], pa.list_(pa.int32())), pa.array([right], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "last", "low", "left", "right"])


def _beyond(edges: list, step: int) -> dict[int, list[int]]:
    """For each part the running minima that names of the parts before it (step 1) or after it (step -1) leave at its edge."""
    out, now, last = {}, [], None
    for e in edges[::step]:
        near, far = (e["first"], e["last"]) if step > 0 else (e["last"], e["first"])
        if last is not None:
            _descend(now, _common(bytes(last), bytes(near)))
        out[e["part"]] = list(now)
        if e["low"] >= 0:
            now = [v for v in now if v < e["low"]] + list(e["left"] if step > 0 else e["right"])
        last = far
    return out


def _ends(before: dict[int, list[int]], after: dict[int, list[int]]):
    """Rows (part, name) in order: each name with the lengths at which the nodes on its way end."""

    def run(batches):
        for part, some in _runs(batches):
            common = [_common(a, b) for a, b in zip(some, some[1:])]
            stack, left = list(before[part]), []
            for i in range(len(some)):
                if i:
                    _descend(stack, common[i - 1])
                left.append(tuple(stack))
            stack, ends = list(after[part]), [None] * len(some)
            for i in range(len(some) - 1, -1, -1):
                if i < len(some) - 1:
                    _descend(stack, common[i])
                ends[i] = sorted({*left[i], *stack, len(some[i])})
            for lo in range(0, len(some), 10_000):
                names = [n.decode("utf-8", "surrogatepass") for n in some[lo : lo + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ends[lo : lo + 10_000], pa.list_(pa.int32()))], names=["name", "ends"])

    return run


def paths(names: DataFrame) -> DataFrame:
    """(name, ends): the lengths in bytes, in order, at which the radix nodes on the way to each name end, its own last.

    An index of names (with ``ends``) is taken as it is.  Empty and null names
    have no node.
    """
    if "ends" in names.columns:
        return names.select("name", "ends")
    spark = names.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = names.select("name").where("name <> ''").distinct()
    placed = materialize(distinct.repartitionByRange(n, "name").select(F.spark_partition_id().alias("part"), "name"), "names")
    ordered = placed.repartition(n, "part").sortWithinPartitions("part", "name")
    edges = sorted(ordered.mapInArrow(_edges, "part int, first binary, last binary, low int, left array<int>, right array<int>").collect(), key=lambda e: e["part"])  # a row for each range
    return ordered.mapInArrow(_ends(_beyond(edges, 1), _beyond(edges, -1)), "name string, ends array<int>")


def _until(end: Column | str) -> Column:
    """The first bytes of a name."""
    return F.substring(F.col("name").cast("binary"), F.lit(1), F.col(end) if isinstance(end, str) else end)


def radix_nodes(names: DataFrame) -> DataFrame:
    """(node, depth, parent, label, is_terminal): every node once; the parent of a top node is empty."""
    at = paths(names).select("name", "ends", F.posexplode("ends").alias("k", "end"))
    before = F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(0)
    each = at.select(_until("end").alias("node"), (F.col("k") + 1).alias("depth"), before.alias("before"), (F.col("end") == F.octet_length("name")).alias("whole"))
    # a node has one depth and one parent, whichever name it is read from
    out = each.groupBy("node").agg(F.max("depth").alias("depth"), F.max("before").alias("before"), F.max("whole").alias("is_terminal"))
    parent = F.substring("node", F.lit(1), F.col("before"))
    label = F.substring("node", F.col("before") + 1, F.octet_length("node"))
    return out.select(F.col("node").cast("string").alias("node"), "depth", parent.cast("string").alias("parent"), label.cast("string").alias("label"), "is_terminal")


def children(nodes: DataFrame, node: str) -> DataFrame:
    """The nodes right below one (the empty string: the top), in order of their labels' bytes."""
    return nodes.where(F.col("parent") == node).orderBy("label")


def parent(nodes: DataFrame, node: str) -> DataFrame:
    """The node right above one; none above a top node."""
    up = nodes.where(F.col("node") == node).select(F.col("parent").alias("node"))
    return nodes.join(F.broadcast(up), "node", "left_semi")


def ranked(names: DataFrame) -> DataFrame:
    """(name, ends, radix_depth, fold, star_id): the index of names that lookups read."""
    depth = paths(names).select("name", "ends", F.size("ends").alias("radix_depth"), ascii_fold(F.col("name")).alias("fold"))
    return with_row_index(depth, ["radix_depth", "name"], "star_id")


def suggest_prefix(names: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(name, rank): names that begin with ``prefix`` but for the case of A-Z, in radix order below the nodes where it ends.

    With an index of names the prefix is a filter on its column ``fold``, which
    reaches the files; without one the index is made first.
    """
    low = prefix.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    index = names if {"ends", "fold"} <= set(names.columns) else paths(names).withColumn("fold", ascii_fold(F.col("name")))
    own = index.where(F.col("fold").startswith(low)) if low else index
    size = len(prefix.encode())
    first = F.lit(-1) if not size else F.expr(f"array_position(transform(ends, e -> e >= {size}), true) - 1").cast("int")
    start = F.when(F.lit(not size), F.lit(b"")).otherwise(_until(F.get("ends", first)))
    order = [F.col("below"), F.col("start_depth"), F.col("start"), F.col("name")]
    found = own.select("name", (F.size("ends") - 1 - first).alias("below"), (first + 1).alias("start_depth"), start.alias("start")).orderBy(*order).limit(limit)
    # the limit bounds the rows that are numbered in one task
    return found.select("name", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def suggest_lex(names: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(name, rank): names whose Unicode lower case begins with that of ``prefix``, in order of lower case, then bytes."""
    order = [F.lower("name"), F.col("name")]
    found = names.select("name").distinct().where(F.startswith(F.lower("name"), F.lower(F.lit(prefix)))).orderBy(*order).limit(limit)
    return found.select("name", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def find_ci(names: DataFrame, name: str) -> DataFrame:
    """(name, place): the first name equal but for case, and its place in lower-case order."""
    distinct = names.select("name").distinct()
    hit = distinct.where(F.lower("name") == F.lower(F.lit(name))).agg(F.min("name").alias("name"))
    before = F.lower("name") < F.lower(F.lit(name))
    return hit.join(F.broadcast(distinct.where(before).agg(F.count("*").alias("place")))).where("name is not null")


def label_counts(names: DataFrame, k: int) -> DataFrame:
    """(label, n): the most frequent labels of radix nodes; ties in order of label."""
    return radix_nodes(names).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def palette(nodes: DataFrame, most: int = PALETTE_16) -> DataFrame:
    """(label, n, number): the ``most`` most frequent labels, numbered from 0 in order of frequency, then label."""
    top = nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)
    return top.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1)  # of at most ``most`` rows


def encoded(nodes: DataFrame, most: int = PALETTE_16) -> DataFrame:
    """Nodes with ``number``, their label's in the palette, and ``bits``: 8, 16, or 32 for labels that aren't in it."""
    known = palette(nodes, most).select("label", "number")
    bits = F.when(F.col("number") < PALETTE_8, 8).when(F.col("number").isNotNull(), 16).otherwise(32)
    return nodes.join(F.broadcast(known), "label", "left").withColumn("bits", bits)


def contained_labels(names: DataFrame) -> DataFrame:
    """(label, hosts): labels that stand inside other labels, and inside how many.  Substrings are joined by equality."""
    labels = radix_nodes(names).select("label").distinct()
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(F.sequence(F.lit(1), F.length("label") - i + 1), lambda n: F.substring(F.col("label"), i, n))))
    inner = labels.select(F.col("label").alias("host"), F.explode(F.array_distinct(spans)).alias("label")).where("host <> label")
    return inner.join(labels, "label").groupBy("label").agg(F.count("*").alias("hosts"))


def overlaps(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the longest suffix of a that begins b."""
    return pairs.withColumn("overlap", overlap(F.col("a"), F.col("b")))


def catalog_stats(names: DataFrame, most: int = PALETTE_16) -> DataFrame:
    """Counts over the radix tree: nodes, names, labels, their bytes, how many nodes have labels of 8, 16 and 32 bits, and the bytes all of it takes.

    ``size`` is that of the tree as bits: two for each node (one for itself,
    one where its siblings end) and one that marks names, in words of 64 bits
    each; labels as numbers of 8, 16 or 32 bits with two marks for each; the
    palette; the distinct labels' bytes.
    """
    n = encoded(radix_nodes(names), most)
    by = n.groupBy("label").agg(F.count("*").alias("uses"))
    total = n.agg(F.count("*").alias("nodes"), F.sum(F.col("is_terminal").cast("long")).alias("names"), F.sum(F.octet_length("label")).alias("label_bytes"), F.max("depth").alias("deepest"), *[F.count(F.when(F.col("bits") == b, 1)).alias(f"labels_{b}") for b in (8, 16, 32)])
    both = total.join(F.broadcast(by.agg(F.count("*").alias("labels"), F.sum(F.octet_length("label")).alias("distinct_bytes"), F.max("uses").alias("most_used"))))

    def words(bits: Column) -> Column:
        return F.ceil(bits / 64) * 8

    size = words(2 * F.col("nodes") + 3) + 3 * words(F.col("nodes") + 1) + F.col("labels_8") + 2 * F.col("labels_16") + 4 * F.col("labels_32") + 4 * F.least("labels", F.lit(most)) + F.col("distinct_bytes")
    return both.withColumn("size", size.cast("long"))
