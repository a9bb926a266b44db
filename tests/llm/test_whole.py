"""The operators do the whole job: cases that an earlier, thinner version failed."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import langid, mixing, wrappers
from tests.llm.helpers import docs

# LM scoring


def slow_score(text, code, tables, weights, stride=96):
    """Log probability of one text, all predictors and the offset corrected after every ``stride`` bytes."""
    symbols, before, hashed, *_ = mixing.contexts([text])
    own, offset, total = np.zeros(mixing.HASHED + 1), 0.0, 0.0
    for lo in range(0, len(symbols), stride):
        step, shift = np.zeros(mixing.HASHED + 1), 0.0
        for i in range(lo, min(lo + stride, len(symbols))):
            place, n = code.decisions(symbols[i : i + 1], before[i : i + 1])
            raw = [tables[k][mixing._slot(h[i : i + 1], n, code.salt[place], len(tables[k]).bit_length() - 1)] for k, h in enumerate(hashed)]
            gate = (raw[1] & 3) * 4 + (raw[2] & 3)
            odds = np.array([*(mixing._ODDS[r] for r in raw), code.direct[place]], float)
            x = (odds * (weights[gate, :-1].T + own[:, None])).sum(axis=0) + weights[gate, -1] + offset
            sign = -code.against[place]
            total -= np.log1p(np.exp(np.minimum(-sign * x, 30))).sum()
            error = sign / (1 + np.exp(sign * x))
            step += (odds * error).sum(axis=1)
            shift += error.sum()
        own += mixing.STEP * step
        offset += mixing.STEP * shift
    return total


def test_every_stride_of_a_long_text_is_refined():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 50, (256, 256)).astype(float)
    code = mixing.Code(pairs)
    tables = [rng.integers(112, 144, 1 << b).astype(np.uint8) for b in (16, 15, 14)]
    weights = np.full((mixing.GATES, mixing.HASHED + 2), 0.2, np.float32)
    weights[:, -1] = 0
    texts = [b"some words and more " * 200, b"short", b"other " * 300]
    got = mixing.score_texts(texts, code, tables, weights)[0]
    assert got == pytest.approx([slow_score(t, code, tables, weights) for t in texts], rel=1e-4)


def test_counts_survive_packing():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, 2 * mixing.PART).astype(np.int32)
    counts[rng.integers(0, len(counts), 200)] = rng.integers(16, 1 << 30, 200)
    assert (mixing._unpacked(mixing._packed(counts)) == counts).all()
    assert (mixing._unpacked(counts.astype("<i4").tobytes()) == counts).all()


@pytest.mark.parametrize(("group", "wide", "full"), [(mixing.GROUP, mixing.WIDE_BITS, mixing.FULL), (2, 14, 50)])
def test_tables_count_every_training_text_and_scores_follow_from_them(spark, monkeypatch, group, wide, full):
    """By brute force: decisions of all training texts, long and short, one by one; then the score of each text."""
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "WIDE_BITS", wide)
    monkeypatch.setattr(mixing, "FULL", full)
    monkeypatch.setattr(mixing, "GATHER", 3000)
    rng = np.random.default_rng(7)
    some = [(i, " ".join(rng.choice("the cat sat on a mat and ran home again".split(), int(rng.integers(1, 40))))) for i in range(60)] + [(100, "long " * 4000), (101, None), (None, "no id")]
    training = [(i, t) for i, t in some if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    model = mixing.Model(docs(spark, training).repartition(5).select("doc_id", "text"))
    counts = [np.zeros((len(t), 2), int) for t in model.tables]
    for _, t in training:
        symbols, before, hashed, *_ = mixing.contexts([mixing.text_bytes(t)])
        for i in range(len(symbols)):
            place, n = model.code.decisions(symbols[i : i + 1], before[i : i + 1])
            for k, h in enumerate(hashed):
                np.add.at(counts[k], (mixing._slot(h[i : i + 1], n, model.code.salt[place], model.bits[k]), model.code.bit[place]), 1)
    for table, c in zip(model.tables, counts, strict=True):
        odds = np.clip(np.round(np.log((c[:, 1] + mixing.PRIOR) / (c[:, 0] + mixing.PRIOR)) / mixing.UNIT), -32, 31)
        seen = c.sum(axis=1) > 0
        assert ((table >> 2).astype(int) - 32 == odds)[seen].all() and (table[~seen] == 128).all()
        assert ((table & 3) == np.searchsorted(mixing.SURE, c.sum(axis=1), "right"))[seen].all()
    got = mixing.score_texts([mixing.text_bytes(t) for _, t in some], model.code, model.tables, model.weights)[0]
    assert got == pytest.approx([slow_score(mixing.text_bytes(t), model.code, model.tables, model.weights) for _, t in some], rel=1e-3)
    scored = {r["doc_id"]: r["score"] for r in mixing.score_documents(docs(spark, some)).collect()}
    assert len(scored) == len(some) and all(v < 0 for v in scored.values())


def test_counting_holds_little_beside_its_counts(monkeypatch):
    """Two workers count beside a JVM that has most of an executor's memory, so what a gather takes is bounded, and what is kept aside for frequent contexts too."""
    monkeypatch.setattr(mixing.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    rng = np.random.default_rng(5)
    column = pa.array([" ".join(rng.choice([f"w{i * i}" for i in range(4000)], 300)) for _ in range(1500)])
    symbols, before, *_ = mixing.contexts([mixing.text_bytes(t) for t in column.to_pylist()], hashing=False)
    shared = type("Shared", (), {"value": mixing.Code(np.bincount(before.astype(np.int64) * 256 + symbols, minlength=65536).reshape(256, 256).astype(float))})
    bits = (20, 20, 20)
    tracemalloc.start()
    try:
        sent = sum(b.num_rows for b in mixing._tally(shared, bits)([pa.RecordBatch.from_arrays([column], names=["text"])]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent == len(mixing._blocks(bits))
    assert peak < sum(4 << b for b in bits) + (48 << 20)


def test_tables_grow_with_the_training_texts():
    bits = [mixing.table_bits(n) for n in (0, 10**5, 10**7, 10**8, 10**12)]
    assert all(all(a <= b for a, b in zip(x, y, strict=True)) for x, y in zip(bits, bits[1:])) and bits[1] < bits[2] and bits[-1] == mixing.MOST


def test_the_gradient_is_the_slope_of_the_score(monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 0.0)
    monkeypatch.setattr(mixing, "HELD", 150)
    rng = np.random.default_rng(2)
    code = mixing.Code(rng.integers(0, 9, (256, 256)).astype(float))
    tables = [rng.integers(100, 156, 1 << b).astype(np.uint8) for b in (16, 15, 14)]
    texts, weights = [b"some words and more", b"", b"other words " * 9], np.full((mixing.GATES, mixing.HASHED + 2), 0.2)
    got = mixing.gradient(texts, code, tables, weights)
    for gate, k in ((0, 0), (5, 1), (10, 2), (15, 3), (6, 4)):
        ends = []
        for d in (0.01, -0.01):
            w = weights.copy()
            w[gate, k] += d
            ends.append(mixing.score_texts(texts, code, tables, w)[0].sum())
        assert got[gate, k] == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.02, abs=0.05)


def test_scores_do_not_depend_on_the_symbols_held(monkeypatch):
    rng = np.random.default_rng(3)
    code = mixing.Code(rng.integers(0, 9, (256, 256)).astype(float))
    tables = [rng.integers(112, 144, 1 << b).astype(np.uint8) for b in (16, 15, 14)]
    texts = [b"word " * int(n) for n in rng.integers(0, 90, 40)]
    whole = mixing.score_texts(texts, code, tables, mixing.first_weights())[0]
    for held in (100, 500):
        monkeypatch.setattr(mixing, "HELD", held)
        assert mixing.score_texts(texts, code, tables, mixing.first_weights())[0] == pytest.approx(whole, rel=1e-6)


def test_every_training_text_fits_the_weights(spark, monkeypatch):
    """Each training text is in one round and one half; the tables of the halves together count what the last ones count."""
    seen, fit = {}, mixing.fit_weights

    def watch(texts, code, halves):
        seen["rows"], seen["halves"] = texts.collect(), halves
        return fit(texts, code, halves)

    monkeypatch.setattr(mixing, "fit_weights", watch)
    some = [(i, f"text number {i} of many") for i in range(700)]
    mixing.Model(docs(spark, some).select("doc_id", "text"))
    assert sorted(r["text"] for r in seen["rows"]) == sorted(t for _, t in some)
    assert {r["half"] for r in seen["rows"]} == {0, 1} and {r["round"] for r in seen["rows"]} == set(range(mixing.ROUNDS))
    assert any((a != b).any() for a, b in zip(*seen["halves"], strict=True))


# Language identification


def test_any_number_of_labels(spark, monkeypatch):
    """More labels than a task holds, each with words of its own letters."""
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 6 * 140)]
    texts = [" ".join("".join(alphabet[6 * k + (i + j) % 6] for j in range(4)) for i in range(12)) for k in range(140)]
    some = [(1000 * r + k, t, f"l{k:03}") for r in range(4) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(docs(spark, some)).collect()}
    learnt = {lang for i, _, lang in some if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(learnt) > 128
    assert all(got[i] == lang for i, _, lang in some if lang in learnt)


def test_lookups_in_parts_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.standard_normal((langid.BUCKETS, 3)).astype(np.float32)
    h, starts, _ = langid.grams(["some words of one text", "x", "averyveryverylongword and others"])
    whole = langid._word_likelihoods(table, h, starts)
    monkeypatch.setattr(langid, "LOOKED_UP", 9)
    assert (langid._word_likelihoods(table, h, starts) == whole).all()


def test_lettered_documents_stay_when_no_language_was_learnt(spark):
    some = [(1, "hello", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "é", None)]
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs(spark, some, ("lang_pred",))).collect()) == [1, 5]


# HTML extraction

PLAIN = "<body><div><h3>Menu of the site</h3></div><section><h2>About {0}</h2><p>{0} one two three four five</p><div><p>six seven {0} eight nine ten eleven</p></div></section></body>"


def html_pages(spark, some):
    return spark.createDataFrame(some, "page_id long, url string, html string")


@pytest.mark.parametrize("slice_", [wrappers.SLICE, 7])
def test_copies_of_a_page_are_no_template(spark, monkeypatch, slice_):
    monkeypatch.setattr(wrappers, "SLICE", slice_)
    monkeypatch.setattr(wrappers, "PARTS", 4)
    some = [(i, f"http://mirror.org/?session={i}", PLAIN.format("alpha") + f"<!-- {i} -->") for i in range(200)] + [(1000 + i, f"http://one.org/{i}", "<p>Only this paragraph.</p>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(html_pages(spark, some)).collect()}
    assert {got[i] for i in range(200)} == {"About alpha\n\nalpha one two three four five\n\nsix seven alpha eight nine ten eleven"}
    assert {got[1000 + i] for i in range(5)} == {"Only this paragraph."}


@pytest.mark.parametrize(("slice_", "hot"), [(wrappers.SLICE, wrappers.HOT_HOSTS), (5, wrappers.HOT_HOSTS), (5, 0)])
def test_every_page_is_read_by_its_hosts_wrapper(spark, monkeypatch, slice_, hot):
    """65 pages of one host: none keeps a text that all of them have."""
    monkeypatch.setattr(wrappers, "SLICE", slice_)
    monkeypatch.setattr(wrappers, "PARTS", 3)
    monkeypatch.setattr(wrappers, "HOT_HOSTS", hot)
    body = "<body><div><p>{0} one two three four five</p><h4>Imprint</h4><div><p>{0} six seven</p></div></div></body>"
    some = [(i, f"http://host.org/{i}", body.format(f"w{i}")) for i in range(65)] + [(1000 + i, f"http://other{i}.org/", body.format("x")) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(html_pages(spark, some)).collect()}
    assert {i: got[i] for i in range(65)} == {i: f"w{i} one two three four five\n\nw{i} six seven" for i in range(65)}
    assert "Imprint" in got[1000]


def test_wrappers_survive_bytes():
    trees = [wrappers.parse(PLAIN.format(w)) for w in ("a", "b", "c")]
    wrapper = wrappers.infer(trees)
    again = wrappers.load(wrappers.dump(wrapper))
    assert str(again) == str(wrapper)
    wrappers.complete(again)
    assert [g.label for g in wrappers.article(again)] == [g.label for g in wrappers.article(wrapper)] and wrappers.extract(trees[1], again) == wrappers.extract(trees[1], wrapper)
