"""Benchmark decontamination by a broadcast hash set of test n-grams.

Every window of ten consecutive words of a document probes a hash table of the
windows of the benchmark; the text of a window is compared at each hit.  A
benchmark of more bytes than ``BROADCAST_BYTES`` is joined by a shuffle
instead, of hashes alone: words are fetched only for the windows that hit.
No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import fold, materialize, numbered_columns

WINDOW = 10
#: Bytes of the benchmark's windows (words, ids and what arrays take besides) that may be broadcast; also of texts' digests.
BROADCAST_BYTES = 64 << 20
#: Everything in ASCII but digits and lower-case letters stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def with_window_hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """``df`` (ws) with an array w<size> for each size: hashes of the windows at all places, from the hashes of words.

    A window is put together from halves (1, 2, 4, 8 words), so each place
    costs a few hashes of two numbers whatever the size; cutting each window
    out of the array would cost the whole array each time.  The last
    ``size - 1`` places hold what is left of the text and mean nothing.
    """
    out, power = df.withColumn("p1", F.transform("ws", lambda w: F.xxhash64(w))), 1

    def shifted(name: str, by: int) -> Column:
        return F.slice(name, F.lit(by + 1), F.size(name))

    while 2 * power <= max(sizes, default=0):
        out = out.withColumn(f"p{2 * power}", F.zip_with(f"p{power}", shifted(f"p{power}", power), lambda x, y: F.xxhash64(x, y)))
        power *= 2
    for size in sizes:
        parts = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
        out, at = out.withColumn(f"w{size}", F.col(f"p{parts[0]}")), parts[0]
        for p in parts[1:]:
            out, at = out.withColumn(f"w{size}", F.zip_with(f"w{size}", shifted(f"p{p}", at), lambda x, y: F.xxhash64(x, y))), at + p
    return out


def _windows(size: int) -> Column:
    """(pos from 1, size, h) of each whole window of one size."""
    whole = F.slice(f"w{size}", F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(0)))
    return F.transform(whole, lambda h, i: F.struct((i + 1).alias("pos"), F.lit(size).alias("size"), h.alias("h")))


def benchmark_windows(bench: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, size, h, win): each item's distinct windows.  An item of fewer words than ``window`` is one window; one without words, or without an id, has none."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where("size(ws) > 0 and item is not null")
    items = with_window_hashes(items, list(range(1, window + 1)))
    own = F.coalesce(*[F.when(F.least(F.size("ws"), F.lit(window)) == s, _windows(s)) for s in range(1, window + 1)])
    wins = items.select("item", "ws", F.explode(own).alias("w")).select("item", "w.size", "w.h", F.slice("ws", F.col("w.pos"), F.col("w.size")).alias("win"))
    return wins.distinct()


def _bytes(*columns: Column) -> Column:
    """About what a row of these (arrays of) strings takes in a hash table."""
    return F.lit(64) + sum((F.aggregate(c, F.lit(0), lambda s, w: s + 16 + F.octet_length(w)) for c in columns), F.lit(0))


class Known:
    """A benchmark's windows, written once: ``owned`` (item, size, h, win) and ``windows`` (size, h, win, items); their sizes and their bytes."""

    def __init__(self, bench: DataFrame, window: int, broadcast_bytes: int):
        self.owned = materialize(benchmark_windows(bench, window=window), "owned")
        weight = self.owned.agg(F.sum(_bytes("win", F.array("item"))).alias("n")).first()["n"] or 0
        self.sizes = sorted(r["size"] for r in self.owned.select("size").distinct().collect())  # at most ``window`` rows
        self.small = weight <= broadcast_bytes
        self.windows = self.owned.groupBy("size", "h", "win").agg(F.collect_set("item").alias("items")) if self.small else self.owned.select("size", "h", "win").distinct()


def _spans(pos: str = "pos", size: str = "size") -> Column:
    return F.sort_array(F.collect_set(F.struct(F.col(pos).alias("pos"), F.col(size).alias("size"))))


def _hits_broadcast(base: DataFrame, keys: list[str], known: Known) -> DataFrame:
    """``base`` (keys, ws) at each hit: keys, pos, size, items.  The table is read once and nothing of it is shuffled."""
    probes = with_window_hashes(base, known.sizes).withColumn("ps", F.concat(F.array().cast("array<struct<pos:int,size:int,h:bigint>>"), *[_windows(s) for s in known.sizes]))
    flat = probes.select(*keys, "ws", F.explode_outer("ps").alias("p"))  # a plain explode would have its arrays made twice, to filter by their size
    right = F.broadcast(known.windows.select(F.col("h").alias("bh"), F.col("win").alias("bwin"), "items"))
    return flat.join(right, (F.col("p.h") == F.col("bh")) & (F.slice("ws", F.greatest(F.col("p.pos"), F.lit(1)), F.col("p.size")) == F.col("bwin"))).select(*keys, "p.pos", "p.size", "items")


def _hits_shuffled(base: DataFrame, known: Known) -> tuple[DataFrame, DataFrame]:
    """Of ``base`` (rid, text), a table on disk: hits (rid, pos, size) and items (rid, item).

    What is shuffled for each word of the corpus is a hash and its place; a
    place that hits a hash is shuffled with its own few words to be compared.
    """
    with_words = base.select("rid", words(F.col("text")).alias("ws"))
    probes = with_window_hashes(with_words, known.sizes).select("rid", F.explode_outer(F.concat(F.array().cast("array<struct<pos:int,size:int,h:bigint>>"), *[_windows(s) for s in known.sizes])).alias("p"))
    found = probes.select("rid", "p.pos", "p.size", "p.h").join(known.windows.select("h").distinct(), "h", "left_semi")
    found = materialize(found.groupBy("rid").agg(F.collect_list(F.struct("pos", "size", "h")).alias("ps")), "places")
    texts = base.join(found, "rid").select("rid", words(F.col("text")).alias("ws"), "ps")
    asked = texts.select("rid", F.explode(F.transform("ps", lambda p: F.struct(p["pos"].alias("pos"), p["size"].alias("size"), p["h"].alias("h"), F.slice("ws", p["pos"], p["size"]).alias("win")))).alias("p"))
    hits = materialize(asked.select("rid", "p.*").join(known.windows, ["size", "h", "win"], "left_semi"), "hits")
    # a window that a document holds often asks for its items once
    own = hits.select("rid", "size", "h", "win").distinct().join(known.owned, ["size", "h", "win"]).select("rid", "item").distinct()
    return hits.select("rid", "pos", "size"), own


def find_hits(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, spans (distinct pos and size), items (array of ids)."""
    known = Known(bench, window, broadcast_bytes)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<struct<pos:int,size:int>>"), F.array().cast("array<string>")
    if not known.small:
        base = materialize(base, "numbered")  # read twice, so its numbers must stay
        hits, own = _hits_shuffled(base.select("rid", "text"), known)
        by = hits.groupBy("rid").agg(_spans().alias("spans")).join(own.groupBy("rid").agg(F.collect_set("item").alias("items")), "rid")
        out = base.select("rid", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(by, "rid", "left")
        return out.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    # the empty window, which an empty row of the table answers, carries each document through the join
    probes = with_window_hashes(base.select("rid", "doc_id", words(F.col("text")).alias("ws")), known.sizes)
    own = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("h")))
    flat = probes.withColumn("ps", F.concat(own, *[_windows(s) for s in known.sizes])).select("rid", "doc_id", "ws", F.explode_outer("ps").alias("p"))
    empty = bench.sparkSession.range(1).select(F.lit([]).cast("array<string>").alias("win"), F.lit([]).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("h"))
    right = F.broadcast(known.windows.select("win", "items", "h").unionByName(empty).select(F.col("h").alias("bh"), F.col("win").alias("bwin"), "items"))
    first = F.col("p.pos") == 0
    same = F.when(F.col("p.size") == 0, F.size("bwin") == 0).otherwise(F.slice("ws", F.greatest(F.col("p.pos"), F.lit(1)), F.col("p.size")) == F.col("bwin"))
    joined = flat.join(right, F.col("p.h") == F.col("bh")).where(same)
    joined = joined.select("rid", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.size("ws")).alias("n"), "p.pos", "p.size", "items")
    spans = F.sort_array(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "size"))))
    return joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n").cast("long").alias("n_words"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).drop("rid")


def covered(spans: Column) -> Column:
    """Words under the union of spans that are sorted by pos."""
    start = F.struct(F.lit(1).alias("end"), F.lit(0).alias("n"))

    def step(acc, s):
        end = s["pos"] + s["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a benchmark window is hit.  Null and empty
    texts have no words; very long ones cost in proportion to their length;
    repeated rows (and rows with null ids) each have a row of their own; an
    empty benchmark hits nothing; items with null text, no words or a null id
    never occur; equal windows of several items count for each of them.  Other
    columns are not read.
    """
    ids = F.array_join(F.sort_array("items"), ",")
    hit = covered(F.col("spans")).cast("long")
    return find_hits(docs, bench, **kw).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hit_texts(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(digest, spans) of each distinct text with a hit, by the SHA-256 of the text; only hits are shuffled, or hashes if the benchmark is large."""
    known = Known(bench, window, broadcast_bytes)
    if known.small:
        base = docs.select(_digest(F.col(text_col)).alias("digest"), words(F.col(text_col)).alias("ws"))
        return _hits_broadcast(base, ["digest"], known).groupBy("digest").agg(_spans().alias("spans"))
    base = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text")), "numbered")
    hits, _ = _hits_shuffled(base, known)
    by = hits.groupBy("rid").agg(_spans().alias("spans"))
    return base.join(by, "rid").select(_digest(F.col("text")).alias("digest"), "spans").groupBy("digest").agg(F.first("spans").alias("spans"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, mode: str = "document", text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` without contamination, in its own columns, whatever their names.

    ``document`` drops rows with any hit; ``span`` keeps every row and takes
    the hit words out of the text, with the gap after each.  Rows stay where
    they lie: what meets them is the digests of contaminated texts, broadcast
    up to ``broadcast_bytes``.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode is document or span, not {mode!r}")
    place = f"c{docs.columns.index(text_col)}"
    rows = numbered_columns(docs)
    hits = materialize(hit_texts(rows, bench, text_col=place, window=window, broadcast_bytes=broadcast_bytes), "contaminated")
    if mode == "document":
        hits = hits.select("digest")
    weight = hits.agg(F.sum(F.lit(128) + (F.size("spans") * 24 if mode == "span" else 0))).first()[0] or 0
    hits = F.broadcast(hits) if weight <= broadcast_bytes else hits
    keyed = rows.withColumn("digest", _digest(F.col(place)))
    if mode == "document":
        return keyed.join(hits, "digest", "left_anti").select(*rows.columns).toDF(*docs.columns)
    text = F.col(place)
    # pieces are words and gaps in turn; a word's number is the number of words before it, plus one
    pieces = F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    lead = F.when(text.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0).otherwise(1)
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["size"] - 1))))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(hit, i + lead)), "")
    clean = F.when(F.col("spans").isNotNull(), kept).otherwise(text)
    out = keyed.join(hits, "digest", "left")
    return out.select(*[(clean if c == place else F.col(c)).alias(c) for c in rows.columns]).toDF(*docs.columns)
