"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import materialize, shuffle_partitions


def _hang(pairs: DataFrame) -> DataFrame:
    """For each node u of pairs (u, v): hang every v, and u itself, on the least of them."""
    spark = pairs.sparkSession
    # dealt out anew after the sum, so that Spark may split a node with very many neighbours in the join
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition(shuffle_partitions(spark))
    own = least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))
    others = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return others.unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id in edges (a, b); root is the least id of its component.

    Self-loops and repeated edges change nothing; edges with a null end are
    left out.  Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """

    def ordered(e):
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, before = materialize(ordered(edges), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == before:
            break
        before = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: only neighbours above u move; u keeps its own edge to the least
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition(shuffle_partitions(edges.sparkSession))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = ordered(large.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        now = materialize(ordered(_hang(large.select(F.col("a").alias("u"), F.col("b").alias("v")))), "edges")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
