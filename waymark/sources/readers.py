"""Readers: system dumps, flat star arrays, journals, name lists, stored values, HTML tables."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.text import parse_float, parse_int
from waymark.sources.tables import JUMP, RAW_SYSTEM, STARS, STORED_ROUTE


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file; the file's own order, over as many tasks as it has splits.

    A line's number is its place in its split and the lines of the splits
    before, one number a split; files of a folder follow one another by path.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("mid"))
    counts = sorted(rows.groupBy("file", "start").agg(F.min("mid").alias("least"), F.count("*").alias("n")).collect(), key=lambda r: (r["file"], r["start"]))  # a row for each split
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["file"], r["start"], total - r["least"]))
        total += r["n"]
    table = spark.createDataFrame(offsets, "file string, start long, shift long")
    return rows.join(F.broadcast(table), ["file", "start"]).select((F.col("mid") + F.col("shift")).alias("line_no"), "value")


def dump_systems(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Systems of a dump, one JSON object a line between ``[`` and ``]``: the first line and everything from a line ending in ``]`` on is left out, one trailing comma is cut."""
    end = lines.where((F.col("line_no") > 0) & F.col("value").endswith("]")).agg(F.min("line_no").alias("end"))
    inside = F.expr("line_no > 0 and (end is null or line_no < end)")
    # a filter on a field may be moved before this one, so the lines outside are null to the parser, too
    text = F.when(inside, F.regexp_replace("value", ",$", ""))
    return lines.join(F.broadcast(end)).where(inside).select("line_no", F.from_json(text, RAW_SYSTEM, {"mode": mode}).alias("s")).select("line_no", "s.*")


def scan_line(value: Column) -> Column:
    """(name, x, y, z) by substrings of one line, null for ``[``, ``]``, empty lines and those without coordinates; escapes stay."""
    number = r"([-+0-9.eE]+)"
    coords = rf'"coords":\{{[^}}]*?"x":{number},"y":{number},"z":{number}\}}'
    fields = [F.regexp_extract(value, coords, i + 1).cast("float").alias(c) for i, c in enumerate("xyz")]
    return F.when(value.rlike(r'"coords":\{'), F.struct(F.regexp_extract(value, r'"name":"([^"]*)"', 1).alias("name"), *fields))


def _triples(batches):
    for b in batches:
        for content in b.column(0).to_pylist():
            xyz = np.frombuffer(content, "<f4", len(content) // 12 * 3).reshape(-1, 3)
            for lo in range(0, len(xyz), 100_000):
                part = xyz[lo : lo + 100_000]
                columns = [pa.array(np.arange(lo, lo + len(part)), pa.int64()), *(pa.array(np.ascontiguousarray(part[:, c]), pa.float32()) for c in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["star_id", "x", "y", "z"])


def star_array(spark: SparkSession, path: str) -> DataFrame:
    """(star_id, x, y, z) of a file of little-endian single-precision triples, 2 GB at most; a rest of fewer than 12 bytes is dropped."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_triples, "star_id long, x float, y float, z float")


def star_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STARS).parquet(path)


def names_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index of names (name, ends, radix_depth, fold, star_id, and what was stored beside)."""
    return spark.read.parquet(path)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("name")).where("name <> ''")


def journal_jumps(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """FSDJump events (line_no and the event's fields) of journal lines; empty lines are skipped, FAILFAST refuses malformed ones."""
    return lines.where("value <> ''").select("line_no", F.from_json("value", JUMP, {"mode": mode}).alias("e")).select("line_no", "e.*").where("event = 'FSDJump'")


def last_jump_of(spark: SparkSession, folder: str, mode: str = "PERMISSIVE") -> DataFrame:
    """The last jump of the journal file changed last: one row, none without a jump."""
    newest = latest_journal(spark, folder).first()
    if not newest or not newest["path"]:
        return journal_jumps(spark.createDataFrame([], "line_no long, value string"), mode)
    return journal_jumps(numbered_lines(spark, newest["path"]), mode).orderBy(F.desc("line_no")).limit(1)


def latest_journal(spark: SparkSession, folder: str) -> DataFrame:
    """(path): the journal file changed last; ties go to the last path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "Journal.*").load(folder)
    return files.agg(F.max(F.struct("modificationTime", "path"))["path"].alias("path"))


def stored_route(value: Column) -> Column:
    """The stored route (nodes, progress) if it is valid, else null: every field present and finite, progress a whole number from 0."""
    parsed = F.from_json(value, STORED_ROUTE, {"mode": "PERMISSIVE"})

    def good(n):
        c = n["system"]["coords"]
        numbers = [c["x"], c["y"], c["z"], n["distance"]]
        ok = n["system"]["name"].isNotNull() & n["refuel"].isNotNull() & n["isNeutron"].isNotNull()
        for v in numbers:
            ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        return F.coalesce(ok, F.lit(False))

    p = parsed["progress"]
    valid = parsed["nodes"].isNotNull() & F.forall(parsed["nodes"], good) & (p >= 0) & (p == F.floor(p))
    return F.when(F.coalesce(valid, F.lit(False)), F.struct(parsed["nodes"].alias("nodes"), p.cast("int").alias("progress")))


class _FirstTable(HTMLParser):
    """Header cells and body rows of the first table; a cell is (text, first link)."""

    def __init__(self):
        super().__init__()
        self.headers, self.rows, self.part, self.cell, self.done, self.inside = [], [], "", None, False, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.inside = True
        elif self.inside and tag in ("thead", "tbody"):
            self.part = tag
        elif self.inside and tag == "tr" and self.part == "tbody":
            self.rows.append([])
        elif self.inside and tag == "td":
            self.cell = ["", None]
        elif self.cell is not None and tag == "a" and self.cell[1] is None:
            self.cell[1] = dict(attrs).get("href")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data

    def handle_endtag(self, tag):
        if tag == "td" and self.cell is not None:
            (self.headers if self.part == "thead" else self.rows[-1] if self.rows else []).append(tuple(self.cell))
            self.cell = None
        elif tag == "table" and self.inside:
            self.inside, self.done = False, True


_CELLS = T.ArrayType(T.MapType(T.StringType(), T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])))


@F.pandas_udf(_CELLS)
def html_table(page: pd.Series) -> pd.Series:
    """Rows of a page's first table, cells by header."""

    def rows(text):
        p = _FirstTable()
        p.feed(text or "")
        names = [h.strip() for h, _ in p.headers]
        return [{n: {"text": c[0], "href": c[1]} for n, c in zip(names, r, strict=False)} for r in p.rows]

    return page.map(rows)


def imported_rows(pages: DataFrame) -> DataFrame:
    """(seq, name, id64, distance, refuel, is_neutron) of a plotted route's table (column ``html``), columns found by header."""
    row = pages.select("*", F.posexplode(html_table("html")).alias("seq", "r")).drop("html")

    def cell(name, field="text"):
        return F.col("r")[name][field]

    link = F.split(cell("System Name", "href"), "/system/")
    return row.select(
        *[c for c in pages.columns if c != "html"],
        "seq",
        F.coalesce(F.trim(cell("System Name")), F.lit("")).alias("name"),
        parse_int(F.get(link, F.lit(1))).alias("id64"),
        parse_float(F.when(F.coalesce(cell("Distance (LY)"), F.lit("")) == "", "0").otherwise(cell("Distance (LY)"))).alias("distance"),
        (F.coalesce(F.trim(cell("Refuel?")), F.lit("")) == "Yes").alias("refuel"),
        (F.coalesce(F.trim(cell("Neutron")), F.lit("")) == "Yes").alias("is_neutron"),
    )
