"""Command line: parse a dump into a catalog, build its indexes, analyse them."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from waymark.operators import catalog, names
from waymark.plans.deploy import ship
from waymark.plans.engine import Engine
from waymark.sources import readers, writers


def parse(spark: SparkSession, dump: str, out: str) -> None:
    """A dump of systems, one JSON object a line, to the rows that a catalog keeps."""
    rows = readers.dump_systems(readers.numbered_lines(spark, dump))
    catalog.keep(catalog.fold_bodies(rows)).write.mode("overwrite").parquet(out)


def build(spark: SparkSession, kept: str, out: str, side: float, partitions: int, array: str | None) -> None:
    """What ``parse`` wrote to a stored catalog: stars by cells and by ids, the index of names; with ``array`` the flat array of coordinates, too."""
    systems = catalog.systems(spark.read.parquet(kept)).where("searchable")
    engine = Engine(spark).set_stars(Engine.with_ids(systems))
    engine.save(out, side, partitions)
    if array:
        writers.write_star_array(engine.stars, array)


def analyze(spark: SparkSession, path: str, queries: list[str], number: int) -> None:
    """Suggestions for some queries, whether each is a name, and counts over the tree of names."""
    engine = Engine(spark).load(path)
    for q in queries:
        print(json.dumps({"query": q, "found": engine.get_star_id(q) is not None, "suggestions": engine.suggest_words(q, number)}, ensure_ascii=False))
    print(json.dumps(names.catalog_stats(engine.index()).first().asDict()))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="waymark", description=__doc__)
    modes = top.add_subparsers(dest="mode", required=True)
    p = modes.add_parser("parse", help=parse.__doc__)
    p.add_argument("dump")
    p.add_argument("out")
    p = modes.add_parser("build", help=build.__doc__)
    p.add_argument("kept")
    p.add_argument("out")
    p.add_argument("--side", type=float, default=0.27)
    p.add_argument("--partitions", type=int, default=8)
    p.add_argument("--array")
    p = modes.add_parser("analyze", help=analyze.__doc__)
    p.add_argument("path")
    p.add_argument("queries", nargs="*")
    p.add_argument("--number", type=int, default=10)
    given = vars(top.parse_args(args))
    mode = given.pop("mode")
    spark = spark or SparkSession.builder.appName("waymark").getOrCreate()
    ship(spark)
    {"parse": parse, "build": build, "analyze": analyze}[mode](spark, **given)


if __name__ == "__main__":
    main()
