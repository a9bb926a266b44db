"""Operators over documents, against brute force and on awkward tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import components, decontaminate, langid, licenses, mixing, packing, simhash
from tests.llm.helpers import crc, docs, rows

CLASH = ("rid", "fp", "row", "h", "k", "shard", "kind", "score", "lang_pred", "root", "_own", "_stay", "item", "win", "c0", "digest", "spans", "none", "f0", "stem", "a.b")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b c d e f g h i j k"), (6, LONG), (6, LONG), (None, "no id here at all"), (8, "ünïcode ÉTÉ 漢字 12"), (9, "!!! ??? 123")]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


# SimHash


def slow_print(t):
    ws = split(t)
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    """{doc_id: smallest reachable id}."""
    left, out = dict(prints), {}
    for i in sorted(prints):
        if i in out:
            continue
        todo, group = [i], {i}
        while todo:
            a = todo.pop()
            for b in left:
                if b not in group and (prints[a] ^ prints[b]).bit_count() <= 4:
                    group.add(b)
                    todo.append(b)
        for g in group:
            out[g] = i
    return out


@pytest.mark.parametrize("width", [2, 3, 4])
def test_position_sets_cover_any_four(width):
    from itertools import combinations

    sets = [set(p) for p in simhash.position_sets(width)]
    assert all(any(p <= set(four) for p in sets) for four in combinations(range(8), 4))


def test_fingerprint_matches_definition():
    for _, t in ODD:
        assert simhash.fingerprint(t) == slow_print(t)


def near_rows():
    rng = np.random.default_rng(3)
    out = []
    for g in range(6):
        base = [f"w{g}x{i}" for i in rng.integers(0, 400, 300)]
        for c in range(8):
            ws = list(base)
            for j in rng.integers(0, 300, c // 3):
                ws[j] = "changed"
            out.append((100 * (g + 1) + c, " ".join(ws)))
    return out + [(i, t) for i, t in ODD if i not in (None, 6)] + [(6, LONG)]


def test_near_duplicates_match_brute_force(spark):
    some = near_rows()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, some, CLASH)).collect()}
    prints = {i: slow_print(t) for i, t in some}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(prints)


@pytest.mark.parametrize(("width", "block", "blocks"), [(2, 16, 64), (2, 16, 1), (3, 16, 1), (3, 2048, 64), (4, 2048, 64), (4, 16, 1)])
def test_links_match_brute_force_at_every_width(spark, monkeypatch, width, block, blocks):
    """Also where long lists are dealt in blocks, and where they are posted anew under one position more."""
    rng = np.random.default_rng(5)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 20, 200)} | {int(x) ^ (1 << int(rng.integers(0, 63))) for x in rng.integers(0, 1 << 62, 60) for _ in range(3)})  # six bytes in common; a few bits apart
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    found = components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), width))
    got = dict(rows(found))
    want = slow_components({f: f for f in fps})
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert rows(components.components(spark.createDataFrame([], "a long, b long"))) == []


def slow_sets(t):
    ws = split(t)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def slow_groups(some):
    """{place: place of the row that stays}: rows (id, text, ...) linked by a similarity of 0.8."""
    sets = [slow_sets(r[1]) for r in some]
    order = sorted(range(len(some)), key=lambda i: (some[i][0] is None, some[i][0] or 0, i))
    out = {}
    for i in order:
        if i in out:
            continue
        todo, group = [i], {i}
        while todo:
            a = todo.pop()
            for b in range(len(some)):
                both = len(sets[a] & sets[b])
                if b not in group and (sets[a] == sets[b] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                    group.add(b)
                    todo.append(b)
        for g in group:
            out[g] = i
    return out


def stays(some):
    groups = slow_groups(some)
    return sorted((some[i] for i, g in groups.items() if i == g), key=str)


def test_deduplication_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    some = near_rows()
    for g in range(40):
        base = [f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(3, 200)))]
        some.append((2000 + 10 * g, " ".join(base)))
        some.append((2005 + 10 * g, "  ".join(base).upper()))
        some.append((2001 + 10 * g, " ".join([*base[: len(base) * 19 // 20], "other"])))
    some += [(None, some[-1][1]), (None, "no id"), (None, "no id")]
    table = docs(spark, some, CLASH)
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns
    got = kept.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == stays(some)
    assert all(r[c] == "x" for r in got for c in CLASH)


@pytest.mark.parametrize(("block", "short", "pairs"), [(2048, 64, 256), (8, 2, 4)])
def test_a_large_group_of_near_copies(spark, monkeypatch, block, short, pairs):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    base = [f"w{i}" for i in range(300)]
    some = [(i, " ".join([*base[: i % 290], f"x{i}", *base[i % 290 :]])) for i in range(120)] + [(500 + i, f"alone {i} in every way {i * 7}") for i in range(30)]
    got = [r["doc_id"] for r in simhash.deduplicate(docs(spark, some)).collect()]
    assert sorted(got) == [i for i, _ in stays(some)] and got.count(0) == 1


def test_similar_texts_are_found(spark):
    """Pairs just above the threshold: nearly all are linked, and none below it."""
    rng = np.random.default_rng(9)
    some = []
    for g in range(300):
        base = [f"u{x}" for x in rng.integers(0, 10**6, 200)]
        other = list(base)
        for j in rng.choice(200, 4 if g % 2 else 8, replace=False):  # similarities of about 0.82 and 0.68
            other[j] = f"y{g}"
        some += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    got = {r["doc_id"] for r in simhash.deduplicate(docs(spark, some)).collect()}
    want = {i for i, _ in stays(some)}
    assert want <= got and len(got - want) <= 0.02 * (len(some) - len(want)) + 1


def test_odd_rows_and_deduplication(spark):
    table = docs(spark, ODD, CLASH)
    got = simhash.near_duplicates(table)
    assert got.count() == len(ODD)
    assert {r["component_id"] for r in got.where("fingerprint = '0000000000000000'").collect()} == {1}
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 8, 9] and ids.count(None) == 1
    empty = docs(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


# Benchmark decontamination


def words9(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow_hits(t, items):
    ws, hit, found = words9(t), set(), set()
    for item, text in items:
        iw = words9(text)
        n = min(10, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, "the quick brown fox jumps over the lazy dog near a river bank"), (2, "short item"), (3, None), (4, "..."), (10, "The quick, brown fox jumps over the lazy dog near A river"), (5, "ÉTÉ 漢字 12 x")]
PLANTED = ODD + [(20, "x y the quick brown fox jumps over the lazy dog near a river bank z"), (21, "SHORT-item! short item item"), (22, "the quick brown fox jumps over the lazy"), (23, "ÉTÉ 漢字 12 x")]


@pytest.fixture
def no_broadcast(spark):
    """Joins are shuffled, as they are of tables that are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_contamination_matches_brute_force(spark):
    got = rows(decontaminate.contamination(docs(spark, PLANTED, CLASH), bench(spark, ITEMS)))
    want = [(i, *slow_hits(t, ITEMS)) for i, t in PLANTED]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_contamination_without_a_broadcast(spark, no_broadcast):
    df = decontaminate.contamination(docs(spark, PLANTED, CLASH), bench(spark, ITEMS), broadcast_bytes=0)
    got = rows(df)
    want = [(i, *slow_hits(t, ITEMS)) for i, t in PLANTED]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    kept = decontaminate.decontaminate(docs(spark, PLANTED, CLASH), bench(spark, ITEMS), broadcast_bytes=0)
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(i) for i, t in PLANTED if not slow_hits(t, ITEMS)[4])
    spans = decontaminate.decontaminate(docs(spark, PLANTED, CLASH), bench(spark, ITEMS), mode="span", broadcast_bytes=0)
    assert {r["doc_id"]: r["text"] for r in spans.collect()}[20] == "x y z"


def test_only_numbers_are_shuffled(spark, no_broadcast):
    """What a hash join shuffles for each word has a fixed size, however long the text."""
    words = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(3000))) for i in range(4)], "rid long, text string")
    known = decontaminate.Known(bench(spark, ITEMS), 10, 0)
    hits, items = decontaminate._hits_shuffled(words, known)
    assert hits.count() == 0 and items.count() == 0
    plan = words.select("rid", decontaminate.words(decontaminate.F.col("text")).alias("ws"))
    probes = decontaminate.with_window_hashes(plan, known.sizes).select("rid", decontaminate.F.explode(decontaminate._windows(10)).alias("p")).select("rid", "p.*")
    assert [t for _, t in probes.dtypes] == ["bigint", "int", "int", "bigint"]


def test_contamination_on_empty_tables(spark):
    assert decontaminate.contamination(docs(spark, []), bench(spark, ITEMS)).count() == 0
    got = decontaminate.contamination(docs(spark, PLANTED), bench(spark, []))
    assert got.count() == len(PLANTED) and got.where("contaminated").count() == 0


def test_decontaminate_drops_documents_or_spans(spark):
    table = docs(spark, PLANTED, CLASH)
    kept = decontaminate.decontaminate(table, bench(spark, ITEMS))
    assert kept.columns == table.columns and all(r[c] == "x" for r in kept.collect() for c in CLASH)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in PLANTED if not slow_hits(t, ITEMS)[4])
    spans = decontaminate.decontaminate(table, bench(spark, ITEMS), mode="span")
    texts = {r["doc_id"]: r["text"] for r in spans.collect()}
    assert texts[20] == "x y z" and texts[21] == "item" and texts[23] == "" and texts[6] == LONG and texts[1] is None
    assert all(slow_hits(t, ITEMS)[1] == 0 for t in texts.values())
    with pytest.raises(ValueError):
        decontaminate.decontaminate(table, bench(spark, ITEMS), mode="other")


# Licences


def test_license_digests(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.TEXTS["MIT"].upper().replace("SUBLICENSE", "sublicense") + "\n"
    isc = licenses.TEXTS["ISC"].replace(",", " ,").replace(". ", ".\n\n  ")
    bsd = licenses.TEXTS["BSD-2-Clause"]
    some = ODD + [(30, mit), (31, isc), (32, bsd + " extra"), (33, "text\nReleased under the MIT Licence.\nmore\nlicensed under the apache license version 2.0\nReleased under the MIT License"), (34, "Released under the MIT License. And more.")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, some, CLASH)).collect()}
    assert [got[i]["license"] for i in (30, 31, 32, 33)] == ["MIT", "ISC", None, None]
    files = {k: t for k, t in licenses.whole_texts()}
    titled = [(40, "MIT License\n\nCopyright (c) 2020 A\n\n" + files["MIT"]), (41, "The MIT License (MIT)\n\n" + files["MIT"]), (42, "ISC Licence\n\n" + files["ISC"]), (43, files["GPL-3.0"].upper()), (44, files["Apache-2.0"].replace("\n", "\n   ")), (45, "BSD 3-Clause License\n\nCopyright (c) 2021, B\nAll rights reserved.\n\n" + files["BSD-3-Clause"]), (46, "MIT License")]
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs(spark, titled)).collect()}
    assert found == {40: "MIT", 41: "MIT", 42: "ISC", 43: "GPL-3.0", 44: "Apache-2.0", 45: "BSD-3-Clause", 46: None}
    lines = [(50, "Licensed under the BSD 3-Clause License"), (51, "This program is distributed under the terms of the GNU General Public License, version 2."), (52, "CC BY 4.0"), (53, "available under CC BY 4.0"), (54, "SPDX-License-Identifier: LGPL-2.1-or-later")]
    assert {r["doc_id"]: r["notices"] for r in licenses.scan_licenses(docs(spark, lines)).collect()} == {50: "BSD-3-Clause", 51: "GPL-2.0", 52: "", 53: "CC-BY-4.0", 54: "LGPL-2.1"}
    assert got[33]["notices"] == "Apache-2.0,MIT" and got[34]["notices"] == "" and got[1]["notices"] == ""
    assert got[1]["text_digest"] == got[2]["text_digest"] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan_licenses(docs(spark, some)).count() == len(some)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    none = licenses.known_digests(spark).limit(0)
    assert licenses.scan_licenses(docs(spark, some), none).where("license is not null or notices <> ''").count() == 0
    own = spark.createDataFrame([("X", "notice", "hello there")], "license string, kind string, body string")
    from pyspark.sql import functions as F

    own = own.select("license", "kind", licenses.digest(F.col("body")).alias("digest"))
    assert licenses.scan_licenses(docs(spark, [(1, "a\nHello, there!")]), own).first()["notices"] == "X"


# Language identification

EN, DE, FR = "the cat sat on the mat and then it ran home with the dog", "der hund und die katze laufen nach hause und schlafen dort", "le chat et le chien courent dans la maison pour dormir"


def lang_rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(120):
        lang, base = [("en", EN), ("de", DE), ("fr", FR)][i % 3]
        out.append((i, " ".join(rng.permutation(base.split())), lang))
    return out


def test_language_accuracy_and_und(spark):
    some = lang_rows() + [(1000 + k, t, None) for k, (_, t) in enumerate(ODD)] + [(2000, EN + " " + DE, "en"), (2001, "... 12 !?", "en")]
    got = {r["doc_id"]: r for r in langid.predictions(docs(spark, some, ("score", "lang_pred", "held_out"))).collect()}
    truth = {i: lang for i, _, lang in lang_rows()}
    assert all(got[i]["lang_pred"] == lang and got[i]["held_out"] == (crc(i) % 4 == 2) for i, lang in truth.items())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1009, 2001)] == ["und"] * 5
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[2000]["lang_set"].count(":") == 2


def test_language_never_reads_lang_of_what_it_predicts(spark):
    some = lang_rows()
    a = rows(langid.predictions(docs(spark, some)).select("doc_id", "lang_pred", "score").orderBy("doc_id"))
    changed = [(i, t, "xx" if crc(i) % 4 == 2 else lang) for i, t, lang in some]
    assert a == rows(langid.predictions(docs(spark, changed)).select("doc_id", "lang_pred", "score").orderBy("doc_id"))


def test_language_on_empty_tables(spark):
    assert langid.predictions(docs(spark, [])).count() == 0
    got = langid.predictions(docs(spark, [(1, "hello", None)])).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    table = docs(spark, lang_rows() + [(500, None), (501, "12")], ("lang_pred", "_lang_pred", "score"))
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == 120 and kept.first()["score"] == "x"


def slow_mixture(likelihood):
    """Proportions of one document by plain loops."""
    k = likelihood.shape[1]
    p = np.exp(likelihood.astype(float) - likelihood.max(axis=1, keepdims=True))

    def fit(pi, rounds):
        for _ in range(rounds):
            pi = np.mean([w * pi / (w * pi).sum() for w in p], axis=0)
        return pi, sum(math.log((w * pi).sum()) if (w * pi).sum() > 0 else -math.inf for w in p)

    pi, best = fit(np.full(k, 1 / k), langid.ROUNDS)
    for _ in range(k - 1):
        if (pi > 0).sum() <= 1:
            break
        smaller = np.where(np.arange(k) == np.where(pi > 0, pi, np.inf).argmin(), 0, pi)
        smaller = smaller / smaller.sum()
        fitted, other = fit(smaller + 1e-12 * (smaller > 0), langid.MORE_ROUNDS)
        if other + langid.PENALTY * math.log(len(p) + 1) < best:
            break
        pi, best = fitted, other
    return pi


def test_mixtures_match_plain_loops():
    rng = np.random.default_rng(6)
    sizes = [1, 2, 7, 40, 90]
    some = [np.float32(rng.normal(-20, 6, (n, 4))) for n in sizes]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        got = langid.mixtures(np.concatenate(some), np.array(sizes))
    for g, s in zip(got, some, strict=True):
        assert g == pytest.approx(slow_mixture(s), abs=1e-3)


def test_long_texts_are_read_in_pieces(monkeypatch):
    """Distinct words and how often they occur say the same as all words."""
    rng = np.random.default_rng(2)
    table = np.float32(rng.normal(-8, 2, (langid.BUCKETS, 3)))
    text = " ".join(rng.choice((EN + " " + DE).split(), 4000))
    whole = langid.predict([text, "x y"], ["a", "b", "c"], table)
    monkeypatch.setattr(langid, "CHUNK", 500)
    pieces = langid.predict([text, "x y", "1 " * 600], ["a", "b", "c"], table)
    assert pieces[0] == [*whole[0], "und"] and pieces[1][:2] == pytest.approx(whole[1], abs=1e-3)


# Packing

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aAbÉéßµ'.,!<|>0 9\n\tΣσςİı漢́≠=")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_equals_tokenizer(t):
    from tokenizers import Tokenizer

    e = packing.encoder(PATH)
    assert np.frombuffer(e.encode([t])[0], "<u2").tolist() == Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids if len(t) < 3 else np.frombuffer(e.encode([t])[0], "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark, sf):
    e = packing.encoder(PATH)
    some = ODD + [(100 + i, f"lorem ipsum {i} " * (i % 400)) for i in range(60)]
    got = packing.pack_documents(docs(spark, some, CLASH), PATH, shard_tokens=5_000).collect()
    want = Counter((i, tuple(e.tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in some)
    by_seq, pieces = {}, {}
    for p in got:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["doc_tokens"], tuple(ids)))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    for i, ps in pieces.items():
        whole = [w for (d, w), n in want.items() if d == i for _ in range(n)]
        assert Counter(x for _, _, ids in ps for x in ids) == Counter(x for w in whole for x in w)
        if len(whole) == 1:
            assert tuple(x for _, _, ids in sorted(ps) for x in ids) == whole[0]
            assert all(n == len(whole[0]) for _, n, _ in ps)
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def slow_neighbours(texts, seed, used):
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(t for d in texts for t in set(d.tolist()))
    score = Counter()
    for t in set(texts[seed].tolist()):
        if 2 * df[t] <= max(n, 2):
            for i, d in enumerate(texts):
                if tf := d.tolist().count(t):
                    score[i] += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
    return {i: v for i, v in score.items() if i not in used}


def test_the_index_returns_every_neighbour_in_order_of_bm25():
    rng = np.random.default_rng(3)
    texts = [np.minimum(rng.zipf(1.3, int(rng.integers(1, 60))), 400).astype(np.uint16) for _ in range(300)]
    index = packing.Index(texts)
    index.used[[3, 5]] = True
    for seed in (0, 17, 200):
        want = slow_neighbours(texts, seed, {3, 5})
        got = list(index.neighbours(seed))
        assert set(got) == set(want)  # more than are ranked at a time, all of them
        assert [want[i] for i in got] == pytest.approx(sorted(want.values(), reverse=True), rel=1e-4)


def test_texts_alike_lie_in_one_shard(spark):
    """Whatever the number of shards: copies are packed with their copies."""
    rng = np.random.default_rng(1)
    some = []
    for g in range(60):
        words = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(60))
        some += [(10 * g + c, words) for c in range(3)]
    got = packing.pack_documents(docs(spark, [some[i] for i in rng.permutation(len(some))]), PATH, shard_tokens=4000).collect()
    windows = {}
    for p in got:
        windows.setdefault(p["doc_id"], set()).add(p["sequence_id"])
    near = sum(any(abs(a - b) <= 12 for a in windows[10 * g] for b in windows[10 * g + 1]) for g in range(60))
    assert near >= 50


def test_packing_prefers_lexical_neighbours():
    a, b = np.arange(100, 200), np.arange(300, 400)
    texts = [a, b, a.copy(), b.copy()]
    order = [p[0] for p in packing.pack(texts)]
    assert order[:2] == [0, 2]


# LM scoring


def slow_base(some):
    train = Counter(w for i, t in some if crc(i) % 7 != 2 for w in [*split(t), None])
    total, distinct = sum(train.values()), len(train)
    out = []
    for i, t in some:
        ws = [*split(t), None]
        out.append((i, crc(i) % 7 == 2, len(ws), sum(w in train for w in ws), total, sum(math.log10((train[w] + 1) / (total + 1 * (distinct + 1))) for w in ws)))
    return out


def test_candidates_do_not_depend_on_the_number_of_texts(spark, monkeypatch):
    """Prints that differ in some 45 bits, of which sets of more positions would find others."""
    rng = np.random.default_rng(11)
    bits = np.repeat(rng.integers(0, 2, (150, 1, 256)), 2, axis=1)
    bits[:, 1] ^= rng.random((150, 256)) < 0.18
    prints = np.packbits(bits.reshape(300, 256).astype(np.uint8), axis=1).view("<i8")
    table = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints)], "rid long, f0 long, f1 long, f2 long, f3 long")
    few = {frozenset(r) for r in rows(simhash.candidates(table))}
    monkeypatch.setattr(type(table), "count", lambda self: 10_000_000)
    assert {frozenset(r) for r in rows(simhash.candidates(table))} == few and len(few) > 20


def test_partners_do_not_depend_on_the_length_of_a_run(monkeypatch):
    rng = np.random.default_rng(12)
    f = np.repeat(rng.integers(0, 1 << 63, (1, 4)), 40, axis=0).astype(np.uint64)
    f[np.arange(40), rng.integers(0, 4, 40)] ^= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)  # many are equally close
    run, none = np.zeros(40, int), np.zeros(40, int)
    got = []
    for short in (64, 1):
        monkeypatch.setattr(simhash, "SHORT", short)
        got.append(set(zip(*(x.tolist() for x in simhash._partners(f, run, none, none.astype(bool))), strict=True)))
    assert got[0] == got[1] and len(got[0]) > 40


@pytest.mark.parametrize("head", [mixing.HEAD, 3])
def test_base_score_matches_brute_force(spark, head):
    some = near_rows() + [(None, "no id")]
    got = sorted(rows(mixing.score_documents(docs(spark, some, CLASH), head_rows=head)), key=str)
    for g, w in zip(got, sorted(slow_base(some), key=str), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] < 0 and g[7] > 0


def test_contexts_do_not_cross_texts():
    texts = [b"", b"a", b"ab cd", b" x  yz\nab ab ", b"the cat the cat sat", b"\n\n", b"q"]
    s, before, hashed, lengths, spoken, words = mixing.contexts(texts)
    assert words.tolist() == [len(t.split()) for t in texts]
    at = 0
    for t, n in zip(texts, lengths, strict=True):
        one = mixing.contexts([t])
        assert bytes(s[at : at + n]) == t + b"\xff" and (before[at : at + n] == one[1]).all()
        assert all((a[at : at + n] == b).all() for a, b in zip(hashed, one[2], strict=True))
        at += n


def test_decisions_are_a_probability():
    """Over all symbols, the products of decisions sum to one."""
    pairs = np.zeros((256, 256))
    pairs[255, 97] = 50
    code = mixing.Code(pairs)
    tables = [np.full(1 << 14, 128, np.uint8) for _ in range(mixing.HASHED)]
    weights = np.full((mixing.GATES, mixing.HASHED + 2), 0.4, np.float32)
    weights[:, -1] = 0
    total = math.exp(mixing.score_texts([b""], code, tables, weights)[0][0])  # of the end at once
    single = 0.0
    for x in range(255):
        place, n = code.decisions(np.array([x], np.uint8), np.array([255], np.uint8))
        odds = code.direct[place] * 0.4
        single += math.exp(-np.log1p(np.exp(odds * code.against[place])).sum())
    assert total + single == pytest.approx(1, rel=1e-4)


def test_scores_learn_from_training_texts_alone(spark, sf):
    some = [(i, " ".join(["alpha beta gamma delta"] * 20)) for i in range(60)] + [(100, "zqxj vkpw " * 20), (101, None), (102, "")]
    got = {r["doc_id"]: r for r in mixing.score_documents(docs(spark, some)).collect()}
    known = next(r for i, r in got.items() if i < 60 and r["held_out"])
    assert known["score"] > known["base_score"] and known["score"] > got[100]["score"]
    assert got[101]["score"] == pytest.approx(got[102]["score"]) and got[101]["n_tokens"] == 1
    assert mixing.score_documents(docs(spark, [])).count() == 0
    alone = mixing.score_documents(docs(spark, [(next(i for i in range(99) if crc(i) % 7 == 2), "a b")])).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0
