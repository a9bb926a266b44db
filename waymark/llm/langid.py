"""Language identification by multilingual mixture inference.

Letter trigrams and bigrams of labelled documents give one hashed n-gram
distribution per language.  A document is a mixture: each word is drawn from
one language, by the likelihood of its n-grams.  Expectation-maximisation
estimates the proportions (after Lui, Lau and Baldwin, 2014); the language set
shrinks one by one as long as the penalised likelihood doesn't fall.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import give_back, numbered_columns

#: Hashed n-grams; languages whose counts a task holds before it sends them on.
BUCKETS, HELD = 1 << 16, 128
#: What every n-gram is taken to have been seen in advance.
PRIOR = 0.1
#: Rounds of expectation-maximisation for the first set and for each smaller one.
ROUNDS, MORE_ROUNDS = 8, 4
#: Log likelihood that one more language must gain, for each unit of log(words + 1); 0.5 is the Bayesian information criterion.
PENALTY = 2.0
#: Characters handled at once with up to FEW languages (fewer with more of them), and log likelihoods looked up at once.
CHUNK, FEW, LOOKED_UP = 1 << 20, 8, 1 << 25

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: hashed n-grams, where each word's n-grams begin, and the number of words in each text.

    A letter at place i of a word has the bigram that ends there, and the
    trigram; the space before the word counts as its first character.
    """
    lowered = [t.lower() for t in texts]
    c = np.frombuffer(("\0" + "\0\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[c]
    code = np.where(letter, c, 0).astype(np.uint32) * np.uint32(0x9E3779B1)
    at = np.nonzero(letter)[0]
    before, before2 = code[at - 1], code[np.maximum(at - 2, 0)]
    before2 = np.where(letter[at - 1], before2, np.uint32(7))
    two = (code[at] ^ (before >> np.uint32(5)) ^ (before << np.uint32(11))) * np.uint32(0x85EBCA6B)
    three = (two ^ (before2 >> np.uint32(3)) ^ (before2 << np.uint32(13))) * np.uint32(0xC2B2AE35)
    h = np.empty(2 * len(at), np.uint32)
    h[0::2], h[1::2] = two >> np.uint32(17), (three >> np.uint32(17)) | np.uint32(1 << 15)
    first = ~letter[at - 1]
    starts = np.nonzero(first)[0] * 2
    ends = np.cumsum([len(t) + 2 for t in lowered])
    words = np.diff(np.concatenate([[0], np.searchsorted(at[first], ends)])) if len(texts) else np.zeros(0, int)
    return h, starts, words


def _chunks(texts: list[str | None], size: int = CHUNK):
    """Slices of texts that hold about ``size`` characters; a text longer than CHUNK has one of its own."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if len(t or "") > CHUNK:
            if lo < i:
                yield lo, i
            yield i, i + 1
            lo, held = i + 1, 0
            continue
        held += len(t or "")
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _count(batches):
    counts: dict[str, np.ndarray] = {}

    def sums():
        for lang, total in counts.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])
        counts.clear()

    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        by_lang: dict[str, list[str]] = {}
        for lang, t in zip(langs, texts, strict=True):
            by_lang.setdefault(lang, []).append(t)
        for lang, some in by_lang.items():
            if lang not in counts and len(counts) == HELD:
                yield from sums()
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for lo, hi in _chunks(some):
                total += np.bincount(grams(some[lo:hi])[0], minlength=BUCKETS)
    yield from sums()


def _dense(counts: pa.Table) -> pa.Table:
    """One language's counts (lang, bucket, n) as one row (lang, counts), the counts of all buckets."""
    total = np.zeros(BUCKETS, np.int64)
    total[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return pa.table({"lang": counts.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log likelihoods (bucket, language), from all rows with text and language."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = {r["lang"]: r["counts"] for r in counts.groupBy("lang").applyInArrow(_dense, "lang string, counts binary").toLocalIterator()}  # a row for each language
    langs = sorted(by_lang)
    table = np.empty((BUCKETS, len(langs)), np.float32)
    for i, lang in enumerate(langs):
        n = PRIOR + np.frombuffer(by_lang.pop(lang), np.int64)
        table[:, i] = np.log(n / n.sum())
    return langs, table


def _sum_by(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _word_likelihoods(table: np.ndarray, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log likelihoods (word, language), looked up for some words at a time."""
    out, most = np.empty((len(starts), table.shape[1]), np.float32), max(1, LOOKED_UP // table.shape[1])
    ends = np.append(starts[1:], len(h))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, "right")))
        out[lo:hi] = _sum_by(table[h[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo])
        lo = hi
    return out


def mixtures(log_likelihood: np.ndarray, words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Language proportions of documents with at least one word each; log_likelihood is (word, language), ``times`` how often each word counts."""
    p = log_likelihood - log_likelihood.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    owner = np.repeat(np.arange(len(words)), words)
    times = np.ones(len(p), np.float32) if times is None else times.astype(np.float32)
    total = np.bincount(owner, times, len(words))
    k = p.shape[1]
    step = max(1, LOOKED_UP // (8 * k))

    def fit(pi, rounds):
        for again in range(rounds + 1):
            shares, likelihood = np.zeros((len(words), k)), np.zeros(len(words))
            for lo in range(0, len(p), step):
                who = owner[lo : lo + step]
                first = np.nonzero(np.diff(who, prepend=-1))[0]
                joint = p[lo : lo + step] * pi[who]
                said = joint.sum(axis=1, keepdims=True)
                weight = times[lo : lo + step]
                if again == rounds:
                    likelihood[who[first]] += _sum_by(np.log(said[:, 0]) * weight, first)
                else:
                    joint *= weight[:, None] / said
                    shares[who[first]] += _sum_by(joint, first)
            if again < rounds:
                pi = (shares / total[:, None]).astype(np.float32)
        return pi, likelihood

    pi, likelihood = fit(np.full((len(words), k), 1 / k, np.float32), ROUNDS)
    price = PENALTY * np.log(total + 1.0)  # of one more language
    for _ in range(k - 1):
        worst = np.where(pi > 0, pi, np.inf).argmin(axis=1)
        smaller = pi.copy()
        smaller[np.arange(len(words)), worst] = 0
        left = smaller.sum(axis=1, keepdims=True)
        single = (pi > 0).sum(axis=1) <= 1
        smaller = np.where(single[:, None], pi, smaller / np.maximum(left, 1e-30))
        # a word that only the dropped language could have said keeps a trace of every other
        fitted, other = fit((smaller + 1e-12 * (smaller > 0)).astype(np.float32), MORE_ROUNDS)
        better = ~single & (other + price >= likelihood) & np.isfinite(other)
        if not better.any():
            break
        pi = np.where(better[:, None], fitted, pi)
        likelihood = np.where(better, other, likelihood)
    return pi


_GAP = re.compile(r"\s")


def _long(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods (distinct word, language) of one long text, read piece by piece, and how often each word occurs."""
    keys, times, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, table.shape[1]), np.float32)
    lo = 0
    while lo < len(text):
        cut = _GAP.search(text, lo + CHUNK)
        hi = cut.end() if cut else len(text)
        h, starts, _ = grams([text[lo:hi]])
        lo = hi
        if not len(starts):
            continue
        # a word is told by the sequence of its n-grams
        place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
        mixed = (h.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(17)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        own = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), starts)
        own, at, n = np.unique(own, return_index=True, return_counts=True)
        seen = np.searchsorted(keys, own)
        old = (seen < len(keys)) & (keys[np.minimum(seen, max(len(keys) - 1, 0))] == own) if len(keys) else np.zeros(len(own), bool)
        times[seen[old]] += n[old]
        new = ~old
        ends = np.append(starts[1:], len(h))
        lengths = ends[at[new]] - starts[at[new]]
        if not new.any():
            continue
        begin = np.cumsum(lengths) - lengths
        picked = np.repeat(starts[at[new]] - begin, lengths) + np.arange(lengths.sum())
        more = _word_likelihoods(table, h[picked], begin)
        order = np.argsort(np.concatenate([keys, own[new]]), kind="stable")
        keys, times, rows = (np.concatenate(x)[order] for x in ((keys, own[new]), (times, n[new]), (rows, more)))
    return rows, times


def predict(texts: list[str | None], langs: list[str], table: np.ndarray) -> tuple[list[str], list[float], list[str]]:
    """Best language, its share, and all languages of the chosen set with their shares, for each text."""
    best, score, sets = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
    if not langs:
        return best, score, sets
    size = CHUNK * FEW // max(FEW, len(langs))
    for lo, hi in _chunks(texts, size):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):  # a set that can't say a word has likelihood zero
            if hi == lo + 1 and len(texts[lo] or "") > CHUNK:
                rows, times = _long(texts[lo], table)
                some, pi = (np.zeros(1, int), mixtures(rows, np.array([len(rows)]), times)) if len(rows) else ([], None)
            else:
                h, starts, words = grams([t or "" for t in texts[lo:hi]])
                some = np.nonzero(words)[0]
                pi = mixtures(_word_likelihoods(table, h, starts), words[some]) if len(some) else None
        if pi is None:
            continue
        # float sums differ in the last digits with the neighbours in a chunk; six digits don't
        pi = np.round(pi.astype(float), 6)
        for i, row in zip((some + lo).tolist(), pi, strict=True):
            top = int(row.argmax())
            best[i], score[i] = langs[top], min(1.0, float(row[top]))
            sets[i] = ",".join(f"{langs[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0)
    return best, score, sets


NAMES = ("lang_pred", "score", "lang_set")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with lang_pred, score and lang_set (or other ``names``); columns of ``docs`` with these names are replaced.

    ``lang_pred`` is the language with the largest share (ties: the first in
    order), ``und`` with score 0 if the text is null or has no letter, or if
    no language was learnt.  Rows, repeated ones too, stay as they are.  A text
    of more than CHUNK characters is read piece by piece into its distinct
    words, which take 4 bytes a language and 16 besides.
    """
    langs, table = model
    new = list(names)
    shown = docs.drop(*new)
    kept = numbered_columns(shown)  # columns go to Python by names without dots
    place = shown.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in zip(new, (T.StringType(), T.DoubleType(), T.StringType()), strict=True))])

    def run(batches):
        give_back()
        for b in batches:
            got = predict(b.column(place).to_pylist(), langs, table)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.string())], names=[*b.schema.names, *new])

    return kept.mapInArrow(run, schema).toDF(*shown.columns, *new)


def predictions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", divisor: int = 4, held: int = 2) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score, lang_set; learnt from the rows that aren't held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held_out = remainder(F.col("doc_id"), divisor) == held
    model = learn(rows.where(~held_out))
    return identify(rows.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def _lettered(place: int):
    """Keeps the rows whose text, the column at ``place``, has a letter."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([any(map(str.isalpha, t or "")) for t in b.column(place).to_pylist()], pa.bool_()))

    return run


#: The share that one language must have in a document for the document to be in it.
LEAST_SHARE = 0.5


def keep_identified(docs: DataFrame, *, languages: list[str] | None = None, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", divisor: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs``, in its own columns, whose text is in one language: a language of ``languages`` (None: any that was learnt) has ``least_share`` of its words or more.

    Rejected are texts without a letter, mixtures that no language leads and,
    with ``languages``, texts in others.  If no language was learnt, all texts
    with a letter stay.
    """
    i, t, g = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, lang_col))
    rows = numbered_columns(docs)
    model = learn(rows.where(remainder(F.col(i), divisor) != held), text_col=t, lang_col=g)
    if not model[0]:
        return rows.mapInArrow(_lettered(rows.columns.index(t)), rows.schema).toDF(*docs.columns)
    led = (F.col("lang_pred") != "und") & (F.col("score") >= least_share)
    if languages is not None:
        led = led & F.col("lang_pred").isin(languages)
    return identify(rows, model, text_col=t).where(led).select(*rows.columns).toDF(*docs.columns)
