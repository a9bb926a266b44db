"""LM scoring by online logistic context mixing (after Mahoney's PAQ).

A text is its lower-cased UTF-8 bytes and an end sign.  Each byte is a path of
binary decisions in a Huffman tree that depends on the byte before, so likely
bytes are few decisions.  For each decision, predictors look up hashed
contexts (the last three bytes, the word so far, the word before with the word
so far, and directly the byte before); their log odds are combined by weights
that a gate selects, and each text refines a correction of the weights and of
the mixed odds as it is read.  The sum of the logarithms is the text's
probability.

Counts of decisions are summed over all training texts, in tables whose slots
grow with these; each task sends its sums in blocks of slots, which are added
up group by group of tasks.  The weights are fitted by rounds of summed
gradients over all training texts, each in one round: texts are dealt to two
halves, and the tables of one half predict the other, so no text meets its own
counts; after that the tables count both halves.  Words of the base score are told by 64-bit
hashes, whose counts are summed by a shuffle; a table of all of them goes to
the tasks if it has at most ``HEAD`` rows, else frequent words go and the rest
are joined.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import give_back, materialize
from waymark.llm.langid import remainder

END = 0xFF  # never a byte of UTF-8
#: Bytes of training text for each slot of a hashed table (three bytes; the word so far; with the word before); the least and the most slots, as powers of two; slots in one block that is sent.
BYTES, FEWEST, MOST, PART = (32, 8, 8), 14, (20, 23, 23), 1 << 14
HASHED = len(BYTES)
#: Tables of so many bits are counted in 16 bits a slot; a symbol that comes so often in a gather, and a count that has come so far, are kept aside from them.
WIDE_BITS, OFTEN, FULL = 19, 32, 1 << 15
#: Tasks whose sums one task adds up; bytes of text that a counting task takes at least, if all cores have work.
GROUP, TALLIED = 64, 64 << 20
#: Bytes between two refinements of a text's correction, and its step size.
STRIDE, STEP = 96, 0.004
#: A slot is a byte: log odds in units of UNIT, 32 more so that they are positive, times four, and how sure they are (0 to 3).
UNIT = 1 / 5
#: What each outcome of a decision is taken to have been seen in advance; counts from which odds are surer by one step.
PRIOR, SURE = 0.4, [2, 12, 100]
_ODDS = ((np.arange(256) >> 2) - 32).astype(np.float32) * np.float32(UNIT)
GATES = 16
#: Rows of the word table that tasks hold: all words, or those whose count is at least N / HEAD.
HEAD = 1 << 22
#: Stands for the end of a text among the hashes of words, which are odd.
END_WORD = 0
#: Rows made into texts at once.
ROWS = 256
#: Rounds of gradients; a hash of its row tells the half and the round of a training text.
ROUNDS = 12
#: Bytes handled at once (arrays of this length stay in a core's cache), and symbols that are gathered before they are counted.
CHUNK, GATHER = 1 << 17, 400_000
#: Gathers after which counts are looked through for full ones; places kept aside before equal ones are summed.
SCANNED, ASIDE = 3, 1 << 17
#: Texts of about one length are scored side by side: WIDE bytes and SIDE texts of them at least, WIDEST bytes at most (one longer text alone), out of WINDOW rows or 3072 times as many bytes.
WIDE, SIDE, WIDEST, WINDOW = 1 << 19, 128, 1 << 20, 4096
#: Rows of a batch of texts to score: the JVM and two workers hold one each beside the model.
BATCH = 3000
#: Symbols whose decisions are held at once, but for the rest of one text's stride.
HELD = 1 << 14

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []
_INSIDE = np.ones(256, bool)  # bytes that words are made of
_INSIDE[[9, 10, 11, 12, 13, 32, END]] = False


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        size = max(n, CHUNK * 2)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_P, inverse)]
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def contexts(texts: list[bytes], hashing: bool = True) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: symbols, the byte before each, hashed contexts, each text's number of symbols, the hashes of all words and each text's number of words."""
    gap = bytes([END])
    b = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    size = len(b)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    firsts = np.cumsum(lengths) - lengths + 1  # places of the texts' first bytes
    powers, inverses = _power_tables(size + 1)
    index = np.arange(size)
    inside = _INSIDE[b]
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
    # where the word so far began; the place itself if there is none
    start = np.maximum.accumulate(np.where(inside, 0, index + 1))[:-1]
    word = sums[1:-1] - sums[start]
    word *= inverses[start]
    # the word that ended last, none at the start of a text; places here are one less than in b
    over = np.nonzero(~inside[1:])[0]
    over = over[inside[over]]  # white space or an end right after a word
    full = np.concatenate([[np.uint64(0)], word[over]])
    spoken = full[1:] ^ (full[1:] >> np.uint64(31))
    spoken *= np.uint64(0xBF58476D1CE4E5B9)
    spoken ^= spoken >> np.uint64(29)
    hashed = []
    if hashing:
        # three bytes back, with end signs where the text hasn't begun
        narrow = b.astype(np.uint32)
        order3 = np.empty(size - 1, np.uint32)
        order3[2:] = narrow[2:-1] | (narrow[1:-2] << np.uint32(8)) | (narrow[:-3] << np.uint32(16))
        order3[:2] = 0
        order3[firsts - 1] = 0xFFFFFF
        second = firsts[lengths > 1]
        order3[second] = narrow[second] | np.uint32(0xFFFF00)
        third = firsts[lengths > 2] + 1
        order3[third] = narrow[third] | (narrow[third - 1] << np.uint32(8)) | np.uint32(0xFF0000)
        order3 *= np.uint32(0x9E3779B1)
        order3 ^= order3 >> np.uint32(15)
        order3 *= np.uint32(0x85EBCA6B)
        marks = np.zeros(size - 1, np.int32)
        marks[over] = 1
        which = np.cumsum(marks, dtype=np.int32) - marks  # words that have ended before a place
        # at a text's first byte, and until a word of its own has ended, there is no word before
        seen = np.repeat(which[firsts - 1], lengths)
        before = np.where(which > seen, full[which], np.uint64(0))
        hashed = [order3, _mix(word * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2)), _mix((word ^ (before * np.uint64(0xA0761D6478BD642F))) * _P + np.uint64(3))]
    words = np.diff(np.searchsorted(over, np.concatenate([[0], np.cumsum(lengths)])))
    return b[1:], b[:-1], hashed, lengths, spoken | np.uint64(1), words


class Code:
    """For each byte before, a Huffman code of all 256 symbols; decisions are numbered over all trees."""

    def __init__(self, pairs: np.ndarray):
        """pairs: counts of (byte before, symbol)."""
        overall = pairs.sum(axis=0) + 1.0
        weights = pairs + 0.5 * overall / overall.sum() + 1e-6
        self.length = np.zeros(65536, np.int64)
        nodes, bits, self.first = [], [], np.zeros(65536, np.int64)
        odds = np.zeros(65536, np.float32)
        for prev in range(256):
            heap = [(w, s, None) for s, w in enumerate(weights[prev].tolist())]
            heapq.heapify(heap)
            node = 256
            while len(heap) > 1:
                (u, i, x), (v, j, y) = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (u + v, node, ((u, i, x), (v, j, y))))
                node += 1
            stack = [(heap[0], [])]
            while stack:
                (w, number, pair), path = stack.pop()
                if pair is None:
                    self.first[prev * 256 + number] = len(nodes)
                    self.length[prev * 256 + number] = len(path)
                    nodes += [n for n, _ in path]
                    bits += [x for _, x in path]
                else:
                    own = prev * 256 + number - 256
                    odds[own] = np.log(pair[1][0] / pair[0][0])
                    stack += [(pair[0], [*path, (own, 0)]), (pair[1], [*path, (own, 1)])]
        node = np.array(nodes, np.uint32)
        self.bit = np.array(bits, np.uint8)
        self.against = 1 - 2 * self.bit.astype(np.float32)  # the sign that makes odds count against what happened
        # no table has slots enough that the last bit of a salt matters, so it tells what happened
        self.salt = (_mix(node.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(9)) & np.uint32(0xFFFFFFFE)) | self.bit
        self.direct = np.clip(odds[node], -9, 9)
        self.salt_direct = _paired(self.salt, self.direct)

    def decisions(self, symbols: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decisions of symbols one after another: their places in the code's tables, and how many each symbol has."""
        place, _, n = self.spread(symbols, before)
        return place, n

    def spread(self, symbols: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``decisions``, with each decision's symbol between them.  Taking by that is faster than repeating."""
        key = before.astype(np.intp)
        key <<= 8
        key |= symbols
        n = self.length.take(key)
        ends = np.cumsum(n)
        # every symbol has a decision, so a mark at each one's first counts them
        which = np.zeros(ends[-1] if len(ends) else 0, np.intp)
        which[ends[:-1]] = 1
        np.cumsum(which, out=which)
        place = (self.first.take(key) - ends + n).take(which)
        place += np.arange(len(place))
        return place, which, n


def _slot(context: np.ndarray, n: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    return _salted(np.repeat(context, n), salt, bits)


def _salted(slot: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    slot ^= salt
    slot >>= np.uint32(32 - bits)
    return slot


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two arrays of 32 bits as one of 64: one take then does for both."""
    out = np.empty((len(a), 2), np.uint32)
    out[:, 0], out[:, 1] = a, b.view(np.uint32)
    return out.view(np.uint64).ravel()


def _looked_up(h0: np.ndarray, h12: np.ndarray, which: np.ndarray, salt: np.ndarray, tables: list[np.ndarray], bits: list[int]) -> list[np.ndarray]:
    """Of each decision the slots of all tables; h12 pairs the word contexts."""
    both = h12.take(which).view(np.uint32)
    hashed = (h0.take(which), both[0::2].copy(), both[1::2].copy())
    return [t.take(_salted(h, salt, b)) for t, h, b in zip(tables, hashed, bits, strict=True)]


def _against(salt: np.ndarray) -> np.ndarray:
    """The sign that makes odds count against what happened."""
    sign = (salt & np.uint32(1)).astype(np.float32)
    sign *= np.float32(-2)
    sign += np.float32(1)
    return sign


def _odds_of(raw: np.ndarray) -> np.ndarray:
    """Log odds of slots, as in _ODDS."""
    odds = (raw >> np.uint8(2)).astype(np.float32)
    odds -= np.float32(32)
    odds *= np.float32(UNIT)
    return odds


def _chunks(texts: list[bytes], size: int = CHUNK):
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _texts(column: pa.Array, size: int = CHUNK):
    """Texts of a column, as lower-cased bytes, about ``size`` bytes at a time; a longer text has a slice of its own."""
    for at in range(0, len(column), ROWS):
        texts = [text_bytes(t) for t in column.slice(at, ROWS).to_pylist()]
        for lo, hi in _chunks(texts, size):
            yield at + lo, texts[lo:hi]


def _windows(column: pa.Array):
    """Texts of a column, as lower-cased bytes, WINDOW rows or some 12 MB at a time, with their place."""
    at, held, texts = 0, 0, []
    for lo in range(0, len(column), ROWS):
        for i, t in enumerate(column.slice(lo, ROWS).to_pylist()):
            texts.append(text_bytes(t))
            held += len(texts[-1])
            if len(texts) >= WINDOW or held >= WINDOW * 3072:
                yield at, texts
                at, held, texts = lo + i + 1, 0, []
    if texts:
        yield at, texts


def _side_by_side(texts: list[bytes]):
    """Places of texts that are scored together: neighbours by length, so that few run on alone."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    some, held = [], 0
    for i in np.argsort(lengths, kind="stable").tolist():
        if some and held + lengths[i] > WIDEST:
            yield some
            some, held = [], 0
        some.append(i)
        held += lengths[i]
        if held >= WIDE and len(some) >= SIDE:
            yield some
            some, held = [], 0
    if some:
        yield some


def _survey(batches):
    """Counts of words by hash (kind 1) and of pairs of bytes (kind 0) of training texts."""
    give_back()
    held, size, pairs, n = [], 0, np.zeros(65536, np.int64), 0

    def flush():
        keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys)), pa.int8()), pa.array(keys.view(np.int64), pa.int64()), pa.array(counts, pa.int64())], names=["kind", "key", "n"])

    for b in batches:
        for _, texts in _texts(b.column(0)):
            symbols, before, _, lengths, words, _ = contexts(texts, hashing=False)
            pairs += np.bincount(before.astype(np.int64) * 256 + symbols, minlength=65536)
            n += len(texts)
            held.append(words)
            size += len(words)
            if size > 2_000_000:
                yield flush()
                size = 0
    yield flush()
    at = np.nonzero(pairs)[0]
    # the end of a text counts as a word
    yield pa.RecordBatch.from_arrays([pa.array([1] + [0] * len(at), pa.int8()), pa.array([END_WORD, *at], pa.int64()), pa.array([n, *pairs[at]], pa.int64())], names=["kind", "key", "n"])


def table_bits(size: int) -> tuple[int, ...]:
    """Slots of the hashed tables, as powers of two, for training texts of ``size`` bytes."""
    return tuple(min(most, max(FEWEST, math.ceil(math.log2(max(size, 1) / each)))) for each, most in zip(BYTES, MOST, strict=True))


def _blocks(bits: tuple[int, ...]) -> list[tuple[int, int]]:
    """(table, part) of each block of slots."""
    return [(k, part) for k, b in enumerate(bits) for part in range((1 << b) // PART)]


def _tally(shared, bits: tuple[int, ...]):
    """Sums of decisions per slot: rows (block, group, counts), a block of one table's slots."""

    def run(batches):
        give_back()
        code = shared.value
        # in a table of many slots no slot gets 2^15 rare symbols in one gather
        counts = [np.zeros(2 << b, np.int32 if b < WIDE_BITS else np.uint16) for b in bits]
        beyond: list[list[tuple]] = [[] for _ in bits]  # places and counts of what 16 bits might not hold
        held: list[list[np.ndarray]] = [[] for _ in bits]

        def aside(k, at, n):
            beyond[k].append((at, n))
            # most places come again and again, so what is kept aside stays about as small as they are
            if sum(len(p[0]) for p in beyond[k][1:]) > max(ASIDE, len(beyond[k][0][0])):
                beyond[k] = [_gathered(beyond[k])]

        def decided(k, keys):
            """Place of each decision in the counts of a table, and its symbol."""
            place, which, _ = code.spread((keys & np.uint64(255)).astype(np.uint8), ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.uint8))
            salt = code.salt.take(place)
            slot = _salted((keys >> np.uint64(16)).astype(np.uint32).take(which), salt, bits[k])
            slot <<= np.uint32(1)
            slot |= salt & np.uint32(1)
            return slot.astype(np.intp), which

        def add(scan):
            # equal symbols in equal contexts are gathered before they become decisions; sorting is faster than counting in place
            for k in range(HASHED):
                keys = np.concatenate(held[k])
                held[k].clear()
                keys.sort()
                firsts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
                keys, times = keys.take(firsts[:-1]), np.diff(firsts)
                del firsts
                if bits[k] >= WIDE_BITS and len(many := np.nonzero(times >= OFTEN)[0]):
                    slot, which = decided(k, keys[many])
                    aside(k, slot, times[many].take(which))
                    times[many] = 0
                times = times.astype(counts[k].dtype)
                for at in range(0, len(keys), HELD):
                    slot, which = decided(k, keys[at : at + HELD])
                    np.add.at(counts[k], slot, times[at : at + HELD].take(which))
                if scan and bits[k] >= WIDE_BITS and counts[k].max() >= FULL:
                    full = np.nonzero(counts[k] >= FULL)[0]
                    aside(k, full, counts[k][full].astype(np.int64))
                    counts[k][full] = 0

        gathered, gathers = 0, 0
        for b in batches:
            for _, texts in _texts(b.column(0)):
                symbols, before, hashed, *_ = contexts(texts)
                said = before.astype(np.uint64) << np.uint64(8)
                said |= symbols
                for k, h in enumerate(hashed):
                    held[k].append((h.astype(np.uint64) << np.uint64(16)) | said)
                gathered += len(symbols)
                if gathered >= GATHER:
                    gathers += 1
                    add(gathers % SCANNED == 0)
                    gathered = 0
        if gathered:
            add(False)
        group = TaskContext.get().partitionId() // GROUP
        more = [_gathered(x) for x in beyond]
        for block, (k, part) in enumerate(_blocks(bits)):
            own = counts[k][2 * PART * part : 2 * PART * (part + 1)].astype(np.int64)
            lo, hi = np.searchsorted(more[k][0], [2 * PART * part, 2 * PART * (part + 1)])
            own[more[k][0][lo:hi] - 2 * PART * part] += more[k][1][lo:hi]
            if own.any():
                yield _sums(block, group, _packed(own))

    return run


def _gathered(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Places, each once and in order, and the sums of their counts."""
    at = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
    at, which = np.unique(at, return_inverse=True)
    return at, np.bincount(which, np.concatenate([np.zeros(0), *(p[1] for p in parts)]), len(at)).astype(np.int64)


def _sums(block: int, group: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([counts], pa.binary())], names=["block", "group", "counts"])


def _packed(counts: np.ndarray) -> bytes:
    """Pairs of counts as bytes of four bits each, and what goes beyond 15 as places and the rest."""
    low = np.minimum(counts, 15).astype(np.uint8)
    over = np.nonzero(counts > 15)[0]
    counts = np.minimum(counts, (1 << 31) - 1)
    return (low[0::2] | (low[1::2] << 4)).tobytes() + over.astype("<u2").tobytes() + (counts[over] - 15).astype("<u4").tobytes()


def _unpacked(counts: bytes) -> np.ndarray:
    """Pairs of counts, packed or whole (32 bits each)."""
    if len(counts) == 8 * PART:
        return np.frombuffer(counts, "<i4")
    out = np.empty(2 * PART, np.int64)
    low, m = np.frombuffer(counts, np.uint8, PART), (len(counts) - PART) // 6
    out[0::2], out[1::2] = low & 15, low >> 4
    out[np.frombuffer(counts, "<u2", m, PART)] += np.frombuffer(counts, "<u4", m, PART + 2 * m)
    return out


def _add_blocks(batches):
    """Rows (block, group, counts) in order of block and group; the sums of each, as pairs of 32-bit counts (what goes beyond stays at the largest)."""
    key, total = None, None

    def done():
        return _sums(*key, np.minimum(total, (1 << 31) - 1).astype("<i4").tobytes())

    for b in batches:
        for *at, counts in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            if at != key:
                if total is not None:
                    yield done()
                key, total = at, np.zeros(2 * PART, np.int64)
            total += _unpacked(counts)
    if total is not None:
        yield done()


_SUMS = "block int, group int, counts binary"


def _summed(sums: DataFrame, tasks: int) -> DataFrame:
    """One row (block, group 0, counts) for each block, whatever the number of tasks that sent it."""
    groups = math.ceil(tasks / GROUP)
    while True:
        sums = sums.repartition("block", "group").sortWithinPartitions("block", "group").mapInArrow(_add_blocks, _SUMS)
        if groups <= 1:
            return sums
        sums, groups = sums.withColumn("group", F.floor(F.col("group") / GROUP).cast("int")), math.ceil(groups / GROUP)


def _odds(batches):
    """Slots as bytes: (block, odds)."""
    for b in batches:
        out = []
        for counts in b.column(2).to_pylist():
            total = _unpacked(counts)
            n0, n1 = total[0::2], total[1::2]
            odds = np.clip(np.round(np.log((n1 + PRIOR) / (n0 + PRIOR)) / UNIT), -32, 31).astype(np.int64)
            out.append(((odds + 32) * 4 + np.searchsorted(SURE, n0 + n1, "right")).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["block", "odds"])


def _tables(sums: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    """The tables of summed blocks, one byte a slot."""
    tables, blocks = [np.full(1 << b, 128, np.uint8) for b in bits], _blocks(bits)
    got = sums.mapInArrow(_odds, "block int, odds binary").toArrow()
    for block, odds in zip(got.column("block").to_pylist(), got.column("odds").to_pylist(), strict=True):
        k, part = blocks[block]
        tables[k][part * PART : (part + 1) * PART] = np.frombuffer(odds, np.uint8)
    return tables


def _gate(raw: list[np.ndarray]) -> np.ndarray:
    """One of 16 weight sets: how sure the two word contexts are."""
    return (raw[1] & np.uint8(3)) << np.uint8(2) | (raw[2] & np.uint8(3))


def _pieces(owner: np.ndarray, cuts: list[int]):
    """Ranges of at most HELD symbols between neighbouring cuts; where they split, a text starts."""
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = lo
        while hi - at > HELD:
            end = lo + int(np.searchsorted(owner[lo:hi], owner[at + HELD]))
            yield at, end
            at = end
        yield at, hi


def score_texts(texts: list[bytes], code: Code, tables: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log probability of each text; the hashes of all words and each text's number of words."""
    bits = [len(t).bit_length() - 1 for t in tables]
    parts = [contexts(texts[lo:hi]) for lo, hi in _chunks(texts)]
    symbols, before, lengths, spoken, words = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4, 5))
    h0, h12 = np.concatenate([p[2][0] for p in parts]), np.concatenate([_paired(*p[2][1:]) for p in parts])
    del parts
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    stride = place // STRIDE
    del place
    stride = stride.astype(np.uint16 if not len(stride) or stride.max() < 1 << 16 else np.int64)  # 16 bits are sorted by radix
    order = np.argsort(stride, kind="stable")  # the first stride of every text, then the second of all that have one
    symbols, before, owner, stride = symbols[order], before[order], owner[order], stride[order]
    h0, h12 = h0[order], h12[order]
    del order
    cuts = np.concatenate([[0], np.nonzero(stride[1:] != stride[:-1])[0] + 1, [len(symbols)]])
    total = np.zeros(len(texts))
    own = np.zeros((HASHED + 1, len(texts)), np.float32)  # each text's correction of the weights
    offset = np.zeros(len(texts), np.float32)  # and of the mixed log odds
    weights = np.ascontiguousarray(weights.T, np.float32)
    for lo, hi in _pieces(owner, cuts.tolist()):
        place, which, n = code.spread(symbols[lo:hi], before[lo:hi])
        both = code.salt_direct.take(place).view(np.uint32)
        salt, direct = both[0::2].copy(), both[1::2].copy().view(np.float32)
        raw = _looked_up(h0[lo:hi], h12[lo:hi], which, salt, tables, bits)
        odds = [*map(_odds_of, raw), direct]
        who = owner[lo:hi]
        first = np.concatenate([[0], np.nonzero(np.diff(who))[0] + 1])
        docs = who[first]
        decided = np.add.reduceat(n, first)
        starts = np.cumsum(decided) - decided
        # a text has each of 16 weight sets with its own correction; how sure the two word contexts are says which
        at = np.repeat(np.arange(0, len(docs) * GATES, GATES), decided)
        at += _gate(raw)
        x = (offset[docs, None] + weights[HASHED + 1]).ravel().take(at)
        for k, o in enumerate(odds):
            w = (own[k, docs, None] + weights[k]).ravel().take(at)
            w *= o
            x += w
        against = _against(salt)
        x *= against
        np.minimum(x, np.float32(30), out=x)
        e = np.exp(x, out=x)
        one = e + np.float32(1)
        error = e
        error /= one
        error *= against
        total[docs] -= np.add.reduceat(np.log(one, out=one), starts)
        for k, o in enumerate(odds):
            own[k, docs] -= STEP * np.add.reduceat(error * o, starts)
        offset[docs] -= STEP * np.add.reduceat(error, starts)
    return total, spoken, words


def gradient(texts: list[bytes], code: Code, tables: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The gradient (GATES, HASHED + 2) of the weights over all decisions of texts, without what a text would correct."""
    bits = [len(t).bit_length() - 1 for t in tables]
    symbols, before, hashed, *_ = contexts(texts)
    columns = np.ascontiguousarray(weights.T, np.float32)
    h0, h12 = hashed[0], _paired(*hashed[1:])
    # the slots of both word contexts tell the gate too: what these, and the gate with the first slot, add to the odds, and sums of errors by the same
    every = np.arange(1 << 16)
    gates = _gate([None, (every >> 8).astype(np.uint8), every.astype(np.uint8)])
    words = columns[1].take(gates) * _ODDS.take(every >> 8) + columns[2].take(gates) * _ODDS.take(every & 255) + columns[HASHED + 1].take(gates)
    first = (columns[0][:, None] * _ODDS[None, :]).ravel()
    by_words, by_first, out = np.zeros(1 << 16), np.zeros(GATES << 8), np.zeros((GATES, HASHED + 2))
    for lo in range(0, len(symbols), HELD):
        hi = lo + HELD
        place, which, _ = code.spread(symbols[lo:hi], before[lo:hi])
        both = code.salt_direct.take(place).view(np.uint32)
        salt, direct = both[0::2].copy(), both[1::2].copy().view(np.float32)
        raw = _looked_up(h0[lo:hi], h12[lo:hi], which, salt, tables, bits)
        gate = _gate(raw).astype(np.intp)
        slot = gate << 8
        slot |= raw[0]
        pair = raw[1].astype(np.intp)
        pair <<= 8
        pair |= raw[2]
        x = columns[HASHED].take(gate)
        x *= direct
        x += first.take(slot)
        x += words.take(pair)
        against = _against(salt)
        x *= against
        np.minimum(x, np.float32(30), out=x)
        error = np.exp(x, out=x)
        error /= error + np.float32(1)
        error *= against
        direct *= error
        error = error.astype(float)
        by_first += np.bincount(slot, error, GATES << 8)
        by_words += np.bincount(pair, error, 1 << 16)
        out[:, HASHED] -= np.bincount(gate, direct, GATES)
    out[:, 0] = -by_first.reshape(GATES, 256) @ _ODDS.astype(float)
    out[:, 1] = -np.bincount(gates, by_words * _ODDS.take(every >> 8), GATES)
    out[:, 2] = -np.bincount(gates, by_words * _ODDS.take(every & 255), GATES)
    out[:, HASHED + 1] = -by_first.reshape(GATES, 256).sum(axis=1)
    return out


def first_weights() -> np.ndarray:
    weights = np.full((GATES, HASHED + 2), 0.3, np.float32)
    weights[:, -1] = 0
    return weights


def _gradient(shared, weights):
    """Rows (half, text): the gradient of the weights, and the texts' bytes, one row a task.  ``shared`` is a broadcast code and the tables of both halves."""

    def run(batches):
        give_back()
        code, halves = shared.value
        total, size = np.zeros((GATES, HASHED + 2)), 0
        for b in batches:
            for half in range(2):
                column = b.column(1).filter(pc.equal(b.column(0), half))
                for _, texts in _texts(column):
                    total += gradient(texts, code, halves[1 - half], weights)
                    size += sum(map(len, texts)) + len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([size], pa.int64())], names=["gradient", "size"])

    return run


def fit_weights(texts: DataFrame, code: Code, halves: list[list[np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of each gate, by gradients summed over all texts (text, half, round), each in its round and by the tables of the other half.

    Without texts the first weights stay.
    """
    weights = first_weights()
    squares = np.full_like(weights, 1e-8)
    shared = texts.sparkSession.sparkContext.broadcast((code, halves))  # sent once, not with every round
    for r in range(rounds):
        some = texts.where(F.col("round") == r).select("half", "text")
        rows = some.mapInArrow(_gradient(shared, weights), "gradient binary, size long").collect()  # a small row for each task
        size = sum(r["size"] for r in rows)
        if not size:
            continue
        g = sum(np.frombuffer(r["gradient"]).reshape(weights.shape) for r in rows) / size
        squares += g * g
        weights += 0.25 * g / np.sqrt(squares)
    shared.destroy()
    return weights


def _score(shared, weights, complete):
    """Rows of kind 0 (a text's scores) and, unless the word table is complete, of kind 1 (its words that aren't in it)."""

    def run(batches):
        give_back()
        code, tables, hashes, times = shared.value
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            for at, texts in _windows(b.column(2)):
                n = len(texts)
                rids = np.arange(rid, rid + n)
                rid += n
                scores, known, base, counts = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
                tail = []
                for some in _side_by_side(texts):
                    m, places = len(some), np.array(some)
                    scores[places], spoken, words = score_texts([texts[i] for i in some], code, tables, weights)
                    # every text ends; each distinct word of the slice is looked up once
                    owner = np.concatenate([np.repeat(np.arange(m), words), np.arange(m)])
                    own, which = np.unique(np.concatenate([spoken, np.full(m, END_WORD, np.uint64)]), return_inverse=True)
                    place = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
                    found = hashes[place] == own if len(hashes) else np.zeros(len(own), bool)
                    log = np.where(found, np.log10(times[place] + 1.0), 0.0) if len(hashes) else np.zeros(len(own))
                    counts[places] = words + 1
                    known[places] = np.bincount(owner, found[which], m)
                    base[places] = np.bincount(owner, log[which], m)
                    if not complete and not found.all():
                        rest = ~found[which]
                        pair, said = np.unique(owner[rest] * len(own) + which[rest], return_counts=True)
                        tail.append((rids[places[pair // len(own)]], said, own[pair % len(own)].view(np.int64)))
                columns = [pa.array(np.zeros(n), pa.int8()), pa.array(rids, pa.int64()), b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(counts, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores / np.log(10), pa.float64()), pa.array([len(t) for t in texts], pa.int64()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=_SCORED)
                for ids, said, word in tail:
                    m = len(ids)
                    columns = [pa.array(np.ones(m), pa.int8()), pa.array(ids, pa.int64()), pa.nulls(m, b.column(0).type), pa.nulls(m, pa.bool_()), pa.array(said, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()), pa.array(word, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=_SCORED)

    return run


_SCORED = ["kind", "rid", "doc_id", "held_out", "n", "known", "base", "score", "bytes", "word"]


class Model:
    """What training texts (doc_id, text) teach: the code, the tables, the weights, and counts of words."""

    def __init__(self, training: DataFrame, head_rows: int = HEAD):
        survey = materialize(training.select("text").mapInArrow(_survey, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"), "survey")
        pairs = np.zeros(65536)
        for key, n in survey.where("kind = 0").select("key", "n").collect():  # at most 65,536 rows
            pairs[int(key)] = n
        self.words = survey.where("kind = 1").select(F.col("key").alias("word"), F.col("n").alias("c"))
        self.tokens, self.distinct = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.complete = self.distinct <= head_rows
        head = (self.words if self.complete else self.words.where(F.col("c") * head_rows >= self.tokens)).toArrow()  # at most HEAD rows
        hashes, counts = head.column("word").to_numpy().view(np.uint64), head.column("c").to_numpy()
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.int64)
        self.size = int(pairs.sum())
        self.code, self.bits = Code(pairs.reshape(256, 256)), table_bits(self.size)
        row = F.xxhash64("doc_id", "text")
        dealt = training.select("text", F.pmod(row, F.lit(2)).cast("int").alias("half"), F.pmod(F.shiftright(row, 1), F.lit(ROUNDS)).cast("int").alias("round"))
        shared = training.sparkSession.sparkContext.broadcast(self.code)
        halves = [self._counts(dealt.where(F.col("half") == h).select("text"), shared) for h in range(2)]
        shared.destroy()
        self.weights = fit_weights(dealt, self.code, [_tables(h, self.bits) for h in halves])
        self.tables = _tables(_summed(halves[0].unionByName(halves[1]), 1), self.bits)

    def _counts(self, texts: DataFrame, shared) -> DataFrame:
        # a task sends whole tables, so few large tasks send less
        tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, math.ceil(self.size / TALLIED))
        texts = texts.coalesce(tasks)
        sums = texts.mapInArrow(_tally(shared, self.bits), _SUMS)
        return materialize(_summed(sums, min(tasks, texts.rdd.getNumPartitions())), "sums")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = 7, held: int = 2, head_rows: int = HEAD) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``score`` is the mixed model's log10 probability of the lower-cased text
    and its end; ``base_score`` the add-one unigram's over words and the end.
    Both learn from the rows that aren't held out.  Null texts are empty and
    have the end alone; repeated rows stay repeated; null ids count as the
    empty text in the choice of what is held out; without training texts every
    word is unknown and the model is uniform over its decisions.  A very long
    text takes some 100 bytes of memory for each of its bytes.  Other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col), divisor) == held).alias("held_out"), F.col(text_col).alias("text"))
    m = Model(rows.where("not held_out").select("doc_id", "text"), head_rows)
    log_total = float(np.log10(m.tokens + m.distinct + 1.0))
    schema = "kind byte, rid long, doc_id long, held_out boolean, n long, known long, base double, score double, bytes long, word long"
    shared = docs.sparkSession.sparkContext.broadcast((m.code, m.tables, m.hashes, m.counts))
    scored = materialize(rows.mapInArrow(_score(shared, m.weights, m.complete), schema), "scored", BATCH)
    shared.destroy()
    tail = scored.where("kind = 1").select("rid", "word", "n").join(m.words, "word", "left")
    tail = tail.groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_base"))
    out = scored.where("kind = 0").join(tail, "rid", "left")
    base = F.col("base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n") * F.lit(log_total)
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(m.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
