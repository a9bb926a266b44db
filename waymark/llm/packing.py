"""Lexical retrieval packing into windows of 2048 tokens.

Documents are tokenised where they lie and sorted by minima of hashes of their
tokens, so that texts with many tokens in common lie side by side, whatever
the size of the corpus; shards of bounded size are cut from that order.  A
shard is a BM25 inverted index: the first unused document seeds a window, the
index returns its unused neighbours, and these fill the window in order of
score.  A document that doesn't fit is cut, and its rest seeds the next
window.  The last window of a shard is cut into sequences whose lengths are
powers of two, which need no padding either.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import give_back, materialize, shuffle_partitions

WINDOW = 2048
#: The id that ends each document.
END = 1
#: Tokens of a shard (some 8 MB of text); a longer document is a shard with others before it.
SHARD_TOKENS = 2_000_000
#: What a document is sorted by: minima of hashes of its runs of so many tokens, and the odd numbers that make the hashes.
SORTED_BY = [(1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35)]
#: BM25's constants; neighbours ranked at a time.
K1, B, RANKED = 1.2, 0.75, 128
# The normaliser and pre-tokeniser of the tokenizer whose pieces between spaces can be encoded alone.
BY_PIECE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Pieces of text (between spaces and line ends) whose ids a Python worker keeps.
CACHE = 500_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_loaded: dict[str, Encoder] = {}
#: Pieces that no normalisation changes and that hold no contraction or special token: a-z, lower-case Latin-1 letters,
#: digits and ASCII punctuation but ' and <.  Their words, single digits and runs of punctuation are merged alone.
_PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:;=->?@\[-`{-~]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=->?@\[-`{-~]+")
#: How byte-level tokenizers write bytes as characters: printable Latin-1 stands for itself, the rest follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Known(dict):
    """Ids of pieces as bytes; a piece that isn't known yet is encoded when it is looked up."""

    def __init__(self, tokenizer, code: str):
        self.encode, self.merge, self.code = tokenizer.encode, tokenizer.model.tokenize, code

    def __missing__(self, p: bytes) -> bytes:
        if p.isalpha() and p.islower():
            ids = array(self.code, [t.id for t in self.merge(p.decode())]).tobytes()
        elif p[-1:] in (b".", b",") and p[:-1].isalpha() and p.islower():
            ids = self[p[:-1]] + self[p[-1:]]
        elif not _PLAIN.fullmatch(text := p.decode("utf-8")):
            ids = array(self.code, self.encode(text, add_special_tokens=False).ids).tobytes()
        elif len(parts := _PARTS.findall(text)) > 1:
            ids = b"".join([self[x.encode()] for x in parts])
            if len(parts) > 2 or len(parts[1]) > 1:
                return ids  # the parts are kept; what they make up may never come again
        else:
            ids = array(self.code, [t.id for t in self.merge(p.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
        self[p] = ids
        return ids


class Encoder:
    """Ids of texts, as little-endian bytes of ``width`` bytes an id.

    A tokenizer that lower-cases, drops white space and splits words from
    punctuation before its merges needs to see a piece between two spaces only
    once, and plain words and punctuation go to its merges directly.  Any
    other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.known = _Known(self.tokenizer, self.code)
        shape = json.loads(self.tokenizer.to_str())
        self.by_piece = all(shape[k] == v for k, v in BY_PIECE.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > CACHE:
            self.known.clear()
        out = []
        for t in texts:
            try:
                # in Latin-1 every way to lower-case agrees; special tokens are told by their case
                t.encode("latin-1")
                b = (t if "<|" in t else t.lower()).encode("utf-8")
            except UnicodeEncodeError:
                b = t.encode("utf-8", "replace")
            pieces = b.replace(b"\n", b" ").split(b" ")
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _minima(ids: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document, minima of hashes of its runs of ids; documents that share most of these mostly share the minima too."""
    x = np.frombuffer(b"".join(ids), f"<u{width}").astype(np.uint32) + np.uint32(1)
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(x))  # ids from each to its document's end
    out = []
    for run, odd in SORTED_BY:
        h = x * np.uint32(odd)
        for k in range(1, run):  # a run that the end cuts is shorter
            following = np.where(left[: len(x) - k] > k, x[k:], np.uint32(0))
            h[: len(x) - k] = (h[: len(x) - k] ^ (h[: len(x) - k] >> np.uint32(16))) * np.uint32(0x45D9F3B) + following * np.uint32(odd)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out.append(np.minimum.reduceat(h, starts))
    return out


def _tokenise(path):
    def run(batches):
        give_back()
        enc = encoder(path)
        end = array(enc.code, [END]).tobytes()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at in range(0, len(texts), 500):
                ids = [x + end for x in enc.encode(texts[at : at + 500])]
                sizes = np.array([len(x) // enc.width for x in ids])
                minima = [pa.array(m, pa.int64()) for m in _minima(ids, sizes, enc.width)]
                yield pa.RecordBatch.from_arrays([*minima, b.column(0).slice(at, 500), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["k0", "k1", "k2", "doc_id", "n", "ids"])

    return run


class Index:
    """BM25 over one shard's documents (arrays of ids); terms of more than half of them tell nothing apart and are left out."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs = docs
        found = [(t, n.astype(np.float32)) for t, n in (np.unique(d, return_counts=True) for d in docs)]
        sizes = np.array([len(t) for t, _ in found])
        terms, tf = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        del found
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        length = np.array([len(d) for d in docs], np.float32)
        held = np.bincount(terms)  # a document has each of its terms once
        telling = (held > 0) & (held * 2 <= max(len(docs), 2))
        number = (np.cumsum(telling) - 1).astype(np.int32)
        kept = telling[terms]
        term, tf, owner = number[terms[kept]], tf[kept], owner[kept]
        del terms, kept
        df = held[telling]
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = idf[term] * tf * np.float32(K1 + 1) / (tf + (K1 * (1 - B + B * length / length.mean())).astype(np.float32)[owner])
        by_term = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")  # 16 bits are sorted by radix
        self.posted, self.weight = owner[by_term], weight[by_term]
        self.lists = np.concatenate([[0], np.cumsum(df)])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(docs)))])
        self.term = term
        self.used = np.zeros(len(docs), bool)

    def neighbours(self, seed: int) -> Iterator[int]:
        """All documents, unused so far, that share a term with the seed, best first; ties in order of the shard."""
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        starts, sizes = self.lists[terms], self.lists[terms + 1] - self.lists[terms]
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        score = np.bincount(self.posted[at], self.weight[at], len(self.docs))
        score[self.used] = 0
        left = np.nonzero(score)[0]
        while len(left):
            edge = np.partition(score[left], len(left) - RANKED)[len(left) - RANKED] if len(left) > RANKED else 0
            best = left[score[left] >= edge]
            yield from best[np.lexsort((best, -score[best]))].tolist()
            left = left[score[left] < edge]


def pack(docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard's documents."""
    index, pieces = Index(docs), []
    sequence, room, following = 0, WINDOW, 0
    queue: Iterator[int] = iter(())
    while True:
        doc, start = next(queue, -1), 0
        if doc < 0:
            while following < len(docs) and index.used[following]:
                following += 1
            if following == len(docs):
                break
            doc = following
        if index.used[doc]:
            continue
        index.used[doc] = True
        fresh = room == WINDOW
        while start < len(docs[doc]):
            take = min(room, len(docs[doc]) - start)
            pieces.append((doc, start, take, sequence, WINDOW - room))
            start, room = start + take, room - take
            if not room:
                sequence, room, fresh = sequence + 1, WINDOW, True
        # what began a window is its seed; a full window leaves the next one to the next seed
        if room == WINDOW:
            queue = iter(())
        elif fresh:
            queue = index.neighbours(doc)
    return _even_end(pieces, sequence, WINDOW - room)


def _even_end(pieces, sequence, held):
    """Cut the last window, of ``held`` tokens, at powers of two."""
    if held in (0, WINDOW):
        return pieces
    ends, at = [], 0
    while at < held:
        at += 1 << ((held - at).bit_length() - 1)
        ends.append(at)
    out = [p for p in pieces if p[3] != sequence]
    for doc, start, length, s, offset in pieces:
        if s != sequence:
            continue
        while length:
            k = next(i for i, e in enumerate(ends) if e > offset)
            take = min(length, ends[k] - offset)
            out.append((doc, start, take, sequence + k, offset - (ends[k - 1] if k else 0)))
            start, length, offset = start + take, length - take, offset + take
    return out


def _pack_shards(most):
    """Rows (doc_id, n, ids) in order, cut into shards of ``most`` tokens."""

    def run(batches):
        give_back()
        rows, held, sequences = [], 0, TaskContext.get().partitionId() << 33

        def done(first):
            docs = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for _, n, x in rows]
            pieces = pack(docs)
            for at in range(0, len(pieces), 2000):
                some = pieces[at : at + 2000]
                columns = [
                    [rows[d][0] for d, *_ in some],
                    [p[1] for p in some],
                    [p[2] for p in some],
                    [docs[d][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in some],
                    [len(docs[p[0]]) for p in some],
                    [first + p[3] for p in some],
                    [p[4] for p in some],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                rows.append(row)
                held += row[1]
                if held >= most:
                    yield from done(sequences)
                    # a shard has at most as many whole sequences as tokens allow, and eleven for its last window
                    sequences += held // WINDOW + 12
                    rows, held = [], 0
        if rows:
            yield from done(sequences)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``ids`` holds little-endian unsigned 32-bit ids.  A document is its text's
    ids and then id 1; null is an empty text; each row is a document of its
    own, also if rows or ids repeat or ids are null.  Every sequence is 2048
    tokens long or a power of two, so nothing is padded.  A very long text is
    cut over sequences; its ids take 2 to 4 bytes each.  An empty table has no
    pieces.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = materialize(rows.mapInArrow(_tokenise(tokenizer_path), "k0 long, k1 long, k2 long, doc_id long, n long, ids binary"), "tokens")
    # the row's place comes last, so documents that are all alike go to many ranges
    place = tokens.withColumn("place", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    order = ["k0", "k1", "k2", "place"]
    ranged = place.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "n", "ids").mapInArrow(_pack_shards(shard_tokens), PIECES)
