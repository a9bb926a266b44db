"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least
four of their eight bytes.  The index posts each distinct fingerprint under
small sets of (position, byte) terms, chosen so that any four positions
contain one of the sets; a pair that meets in a posting list has the bytes it
shares tallied, those below four are dropped, and the rest are verified bit by
bit.  A posting list yields a spanning forest of its links, never all pairs;
a list that is too long for one task is dealt out as pairs of blocks, and one
too long for that is posted anew under one position more.

``deduplicate`` looks for texts whose sets of five-word shingles have a
similarity of 0.8 or more.  Such pairs differ in about 15 % of the bits, where
no number of shared bytes of 64 bits is guaranteed, so it takes fingerprints of
256 bits, posts them under sets of byte positions of which a similar pair
shares some with a probability above 0.99, drops pairs that share too few bytes
or differ in too many bits, and verifies the rest by their shingles.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import give_back, materialize, numbered_columns
from waymark.llm.components import components

SHINGLE = 4
MAX_BITS = 4
#: Of eight bytes, those that a pair within MAX_BITS must share.
MIN_SHARED = 8 - MAX_BITS
#: Fingerprints of one posting list that one task compares at once.
BLOCK = 2048
#: Up to this many distinct fingerprints, sets of two or three positions keep lists short; beyond, sets of four.
WIDTHS = [(2, 600_000), (3, 50_000_000)]
#: Blocks beyond which a posting list is posted anew under one position more instead.
BLOCKS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half the shingles' hashes."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    joined, n = b" ".join(ws), max(len(ws) - shingle + 1, 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in ws])
        starts = np.concatenate([[0], ends[:-1]])
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.uint32) * 2 > n, bitorder="little").view("<u8")[0])


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any four of the eight contain one of them (Turan's constructions)."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    if width == 2:
        return [p for part in parts for p in combinations(part, 2)]
    if width == 3:
        inside = [p for part in parts for p in combinations(part, 3)]
        return inside + [(*p, x) for i, part in enumerate(parts) for p in combinations(part, 2) for x in parts[(i + 1) % 3]]
    return list(combinations(range(8), 4))


def forest(fps: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (fingerprint, the least of its component) among fingerprints; with sides, only links across them are looked for."""
    n = len(fps)
    low, high = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    us, vs = [], []
    step = max(1, (1 << 20) // max(n, 1))
    for i in range(0, n, step):
        x = fps[i : i + step, None] ^ fps[None, :]
        shared = np.bitwise_count(~(((x & low) + low) | x | low) & high)  # a bit for each byte that is equal
        keep = shared >= MIN_SHARED
        keep &= np.arange(n)[None, :] > np.arange(i, min(i + step, n))[:, None]
        if side is not None:
            keep &= side[i : i + step, None] != side[None, :]
        u, v = np.nonzero(keep)
        near = np.bitwise_count(x[u, v]) <= MAX_BITS
        us.append(u[near] + i)
        vs.append(v[near])
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return []
    label = np.arange(n)
    while True:
        low_end = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low_end)
        np.minimum.at(new, v, low_end)
        np.minimum.at(new, label[u], low_end)
        np.minimum.at(new, label[v], low_end)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return list(zip(fps[moved].view(np.int64).tolist(), fps[label[moved]].view(np.int64).tolist(), strict=True))


def _fingerprints(batches):
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(fps, pa.int64())], names=["doc_id", "fp"])


def _links(batches):
    """Rows of (k, i, j, side, fp) in order of k, i, j; the links of each list."""
    key, fps, sides, out = None, [], [], []

    def done():
        if len(fps) > 1:
            split = key[1] != key[2]
            out.extend(forest(np.array(fps, np.int64).view(np.uint64), np.array(sides) if split else None))

    def batch():
        got = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out.clear()
        return got

    for b in batches:
        for k, i, j, s, fp in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
            if (k, i, j) != key:
                done()
                key, fps, sides = (k, i, j), [], []
                if len(out) >= 10_000:
                    yield batch()
            fps.append(fp)
            sides.append(s)
    done()
    yield batch()


def _bytes_at(ps) -> Column:
    """The bytes of a fingerprint at some positions, and a mark of the positions, which keeps lists of different ones apart."""
    packed = sum((F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * at) for at, p in enumerate(ps)), F.lit(0).cast("long"))
    return F.shiftleft(packed, 8) + F.lit(sum(1 << p for p in ps))


def _with_one_more(width: int) -> Column:
    """The keys of lists that any pair of a list (k, fp) that shares four bytes meets in, each of one position more.

    A pair shares ``4 - width`` more of the ``8 - width`` other positions, so
    five of them always hold one that it shares.
    """
    keys = []
    for ps in combinations(range(8), width):
        others = [p for p in range(8) if p not in ps][:5]
        keys.append((sum(1 << p for p in ps), F.array(*[_bytes_at(sorted((*ps, p))) for p in others])))
    mask = F.col("k").bitwiseAND(F.lit(255))
    return F.coalesce(*[F.when(mask == m, more) for m, more in keys])


def links(distinct: DataFrame, width: int | None = None) -> DataFrame:
    """A spanning forest (a, b) per posting list of the pairs within MAX_BITS among distinct fingerprints (fp); ``width``: positions in a term set, chosen by the number of fingerprints if None."""
    n = distinct.count() if width is None else 0
    width = width or next((w for w, most in WIDTHS if n <= most), 4)
    posts = distinct.select("fp", F.explode(F.array(*[_bytes_at(ps) for ps in position_sets(width)])).alias("k"))
    out = []
    while True:
        # the lists too long for a task; there are at most postings / BLOCK of them
        long_lists = materialize(posts.groupBy("k").count().where(F.col("count") > BLOCK).select("k", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "lists")
        longest = long_lists.agg(F.max("blocks")).first()[0] or 1
        refine = width < 4 and longest > BLOCKS
        here = posts.join(long_lists.where(F.col("blocks") > BLOCKS), "k", "left_anti") if refine else posts
        here = here.join(long_lists, "k", "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
        partner = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        dealt = here.select("fp", "k", "block", F.explode(partner).alias("other")).select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "fp")
        listed = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "fp")
        out.append(listed.mapInArrow(_links, "a long, b long"))
        if not refine:
            return reduce(DataFrame.unionByName, out)
        posts = posts.join(long_lists.where(F.col("blocks") > BLOCKS), "k", "left_semi").select("fp", F.explode(_with_one_more(width)).alias("k")).distinct()
        posts, width = materialize(posts, "posts"), width + 1


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs without ASCII white space, A-Z lower-cased; null and empty
    texts have fingerprint zero and link like any other.  ``component_id`` is
    the smallest id reachable over links of at most four bits, the own id
    included; null ids count for nothing there (a component of null ids only
    has a null one).  Repeated rows stay repeated.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(materialize(links(distinct.select("fp")), "links"))
    placed = materialize(distinct.join(roots, distinct["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    classes = materialize(placed.join(named, "root").select("fp", "component_id"), "classes")
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle, and the similarity of shingle sets, from which texts are near-duplicates.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a wide fingerprint; the bytes a pair must share; the bits it may differ in (similar pairs: 39 +- 6 at 0.8).
WIDE, WIDE_SHARED, WIDE_BITS = 4, 3, 56
#: Distances between the byte positions of a term set, for any number of texts: other sets would miss other pairs.
WIDE_SETS = [(1,), (5,)]
#: A list of up to so many is compared side by side with others.
SHORT = 64
#: Rows of numbers that are broadcast, and pairs that one copy of a text is compared in.
FEW, PAIRS = 2_000_000, 256
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_word_hashes = _WordHashes()


def shingles(words: list[bytes], size: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle are one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
    return np.unique(total)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of WIDE words over a set of shingles, as signed numbers."""
    bits = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded whatever the text's length
        for k, salt in enumerate(_SALTS):
            x = hashes[at : at + (1 << 15)] * salt
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            bits[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(hashes), axis=1, bitorder="little").view("<i8").ravel()


def _text_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _wide(batches):
    """Rows (rid, doc_id, text); rid, doc_id, a 128-bit digest of the words, the wide fingerprint."""
    give_back()
    for b in batches:
        n = b.num_rows
        digests, prints = np.zeros((n, 2), "<i8"), np.zeros((n, WIDE), np.int64)
        for i, text in enumerate(b.column(2).to_pylist()):
            ws = _text_words(text)
            digests[i] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(ws)), "<i8")
            prints[i] = wide_fingerprint(shingles(ws))
        columns = [b.column(0), b.column(1), *(pa.array(digests[:, k], pa.int64()) for k in (0, 1)), *(pa.array(prints[:, k], pa.int64()) for k in range(WIDE))]
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "d0", "d1", *(f"f{k}" for k in range(WIDE))])


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _close(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of exclusive ors of wide fingerprints (along the last axis): whether they share enough bytes and bits, and the bits that differ."""
    shared = np.bitwise_count(~(((x & _LOW) + _LOW) | x | _LOW) & _HIGH).sum(axis=-1, dtype=np.int32)
    bits = np.bitwise_count(x).sum(axis=-1, dtype=np.int32)
    return (shared >= WIDE_SHARED) & (bits <= WIDE_BITS), bits


def _partners(f: np.ndarray, run: np.ndarray, side: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (later, earlier) within runs of one list: each with its first close one before it, and its closest one."""
    n = len(run)
    sizes = np.bincount(run)
    first, nearest, best = np.full(n, -1), np.full(n, -1), np.full(n, 1 << 30)
    at = np.nonzero((sizes <= SHORT)[run])[0]
    short = np.zeros(n + 1, bool)
    short[at] = True
    for d in range(1, SHORT):
        at = at[at + d < n]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        some = at[(~split[at]) | (side[at] != side[at + d])]
        close, bits = _close(f[some] ^ f[some + d])
        some, bits = some[close], bits[close]
        first[some + d] = some  # a larger distance is an earlier place
        nearer = bits <= best[some + d]  # of equally close ones the earliest, as in long runs
        nearest[some[nearer] + d], best[some[nearer] + d] = some[nearer], bits[nearer]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for r in np.nonzero(sizes > SHORT)[0].tolist():
        lo, m = int(starts[r]), int(sizes[r])
        own, step = f[lo : lo + m], max(1, (1 << 18) // m)
        for i in range(0, m, step):
            rows = np.arange(i, min(i + step, m))
            close, bits = _close(own[rows][:, None] ^ own[None, : rows[-1] + 1])
            close &= np.arange(rows[-1] + 1)[None, :] < rows[:, None]
            if split[lo]:
                close &= side[lo + rows][:, None] != side[lo : lo + rows[-1] + 1][None, :]
            has = close.any(axis=1)
            first[lo + rows[has]] = lo + close.argmax(axis=1)[has]
            nearest[lo + rows[has]] = lo + np.where(close, bits, 1 << 30).argmin(axis=1)[has]
    later = np.nonzero(first >= 0)[0]
    other = later[nearest[later] != first[later]]
    return np.concatenate([later, other]), np.concatenate([first[later], nearest[other]])


def _candidates(batches):
    """Rows (k, i, j, side, rid, f0..) in order of list and fingerprint; pairs (a, b) of rids, a after b in its list."""
    give_back()
    held: list[np.ndarray] = []
    size = 0

    def done(rows):
        run = np.concatenate([[0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(axis=1))])
        later, earlier = _partners(rows[:, 5:].view(np.uint64), run, rows[:, 3], rows[:, 1] != rows[:, 2])
        pairs = np.unique(np.stack([rows[later, 4], rows[earlier, 4]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c]), pa.int64()) for c in (0, 1)], names=["a", "b"])

    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        held.append(rows)
        size += len(rows)
        if size < 100_000:
            continue
        rows = np.concatenate(held)
        # the last list may go on in the next batch
        last = np.nonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield done(np.ascontiguousarray(rows[:cut]))
        held, size = [rows[cut:]], len(rows) - cut
    if size:
        yield done(np.ascontiguousarray(np.concatenate(held)))


def candidates(texts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of rids whose wide fingerprints (rid, f0, ...) are close, at most two for each text of a posting list."""
    sets = [(i, *((i + d) % (8 * WIDE) for d in ds)) for ds in WIDE_SETS for i in range(8 * WIDE)]

    def byte(p):
        return F.shiftrightunsigned(f"f{p // 8}", 8 * (p % 8)).bitwiseAND(F.lit(255))

    keys = [F.shiftleft(sum((F.shiftleft(byte(p), 8 * at) for at, p in enumerate(ps)), F.lit(0).cast("long")), 9) + F.lit(s) for s, ps in enumerate(sets)]
    own = [f"f{k}" for k in range(WIDE)]
    posts = texts.select("rid", *own, F.explode(F.array(*keys)).alias("k"))
    long_lists = materialize(posts.groupBy("k").count().where(F.col("count") > BLOCK).select("k", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "lists")
    if long_lists.isEmpty():
        zero = F.lit(0)
        dealt = posts.select("k", zero.alias("i"), zero.alias("j"), zero.alias("side"), "rid", *own)
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        dealt = posts.join(_few(long_lists), "k", "left").withColumn("block", F.pmod(F.xxhash64(*own), blocks).cast("int"))
        dealt = dealt.select("rid", *own, "k", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "rid", *own)
    # in order of fingerprints, so that which pairs are compared doesn't depend on where rows lie
    listed = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", *own, "rid")
    return listed.mapInArrow(_candidates, "a long, b long").distinct()


def _few(numbers: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, broadcast if it has at most FEW rows."""
    return F.broadcast(numbers) if numbers.limit(FEW + 1).count() <= FEW else numbers


def _verify(least):
    def run(batches):
        give_back()
        last, own = None, None
        for b in batches:
            out = ([], [])
            for x, y, s, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if y != last:
                    last, own = y, shingles(_text_words(t))
                other = shingles(_text_words(s))
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= least * (len(own) + len(other) - both):
                    out[0].append(x)
                    out[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts (rid, text) have shingle sets of that Jaccard similarity or more; texts move only if they are in a pair."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "asked")
    texts = materialize(texts.join(_few(asked), "rid", "left_semi"), "texts")
    # a text with very many pairs is copied for every PAIRS of them
    hot = materialize(pairs.groupBy("b").count().where(F.col("count") > PAIRS).select("b", F.ceil(F.col("count") / PAIRS).cast("int").alias("copies")), "hot")
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(_few(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), copies).cast("int").alias("copy"))
    right = texts.withColumnRenamed("rid", "b").withColumnRenamed("text", "t").join(_few(hot), "b", "left").select("b", "t", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    left = dealt.join(texts.withColumnRenamed("rid", "a").withColumnRenamed("text", "s"), "a")
    both = left.join(right, ["b", "copy"]).select("a", "b", "s", "t")
    return both.sortWithinPartitions("b").mapInArrow(_verify(similarity), "a long, b long")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each group of near-duplicates, in the columns of ``docs``, whatever their names.

    Texts of equal words (A-Z lower-cased) are copies, also those without
    words; texts whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more are linked, and a group is what links join.  The row with the
    smallest id stays; rows without an id come after those with one, and among
    rows with the same id the first in the table stays.  Very long texts cost
    memory in proportion to their length.  Candidates come from fingerprints,
    so a linked pair near 0.8 may be missed (below one in a hundred), but no
    pair below it is ever linked.
    """
    i, t = (docs.columns.index(c) for c in (id_col, text_col))
    rows = materialize(numbered_columns(docs).withColumn("rid", F.monotonically_increasing_id()), "rows")
    texts = rows.select("rid", F.col(f"c{i}").cast("long").alias("doc_id"), F.col(f"c{t}").alias("text"))
    own = ", ".join(f"f{k} long" for k in range(WIDE))
    prints = materialize(texts.mapInArrow(_wide, f"rid long, doc_id long, d0 long, d1 long, {own}"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    first = [F.first(f"f{k}").alias(f"f{k}") for k in range(WIDE)]
    distinct = materialize(prints.groupBy("d0", "d1").agg(F.min(order).alias("m"), *first).select("m.*", *[f"f{k}" for k in range(WIDE)]), "distinct")
    pairs = materialize(candidates(distinct.select("rid", *[f"f{k}" for k in range(WIDE)])), "pairs")
    roots = components(materialize(verified(pairs, texts.select("rid", "text"), similarity), "links"))
    joined = distinct.select("none", "doc_id", "rid").join(roots.withColumnRenamed("id", "rid"), "rid", "left")
    stay = materialize(joined.groupBy(F.coalesce("root", "rid")).agg(F.min(order).alias("m")).select("m.rid"), "stay")
    gone = materialize(prints.select("rid").join(stay, "rid", "left_anti"), "gone")
    if gone.limit(FEW + 1).count() <= FEW:
        kept = rows.join(F.broadcast(gone), "rid", "left_anti")
    else:
        kept = rows.join(stay, "rid", "left_semi")
    return kept.drop("rid").toDF(*docs.columns)
