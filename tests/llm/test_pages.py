"""Operators over pages and embeddings, and the pipeline."""

import hashlib
import io

import numpy as np
import pytest

from waymark.llm import ann, url_filters, warc, wrappers
from waymark.llm.queries import URL_RULES
from tests.llm.helpers import docs, rows

CLASH = ("key", "bucket", "host", "salt", "block", "kind", "n_chars", "refers_to")


def pages(spark, some, extra=()):
    return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in some], "page_id long, url string, html string" + "".join(f", {c} string" for c in extra))


# URL filters

URLS = [None, "", "no scheme", "http://", "http://example.org", "http://EXAMPLE.org/es/", "https://a.b.example.org/es/x?q#f", "http://example.org/en/12", "http://notexample.org/es/1", "http://x.com/fr/a", "http://x.com/de/", "ftp://com/de/x", "http://x.net/de/", "a://b.org?x://y.com/fr/", "http://org/", "http://a..org/", "http://example.org:80/es/", "http://é.com/fr/é\nx", "http://example,x.org/es/a", "http://org,example/es/", "http://a.org.example,/q", "http://example.org./es/", "http://example.org/es\U0010ffff", "http://\U0010ffff.example.org/es/1", "http://example/.org/es/"]


def slow_judge(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


def test_url_filters_match_brute_force(spark):
    more = [("a.com", "/", "block"), ("b.a.com", "", "allow"), ("example.org", "/es/x", "allow"), ("", "/q", "block")]
    rules = URL_RULES + more
    urls = URLS + [f"http://{h}.a.com{p}" for h in ("", "b", "b.b", "c.b", "d") for p in ("", "/", "/es/x", "/q")] * 3
    some = [(i, u, None) for i, u in enumerate(urls)] + [(None, "http://x.com/fr/", None)] + [(7, "http://hot.example.org/es/", None)] * 300
    table = pages(spark, some, CLASH)
    got = rows(url_filters.filter_urls(table, spark.createDataFrame(rules, "host string, path string, verdict string")))
    want = [(i, *slow_judge(u, rules)) for i, u, _ in some]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_url_filters_on_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filters.filter_urls(pages(spark, []), rules).count() == 0
    got = url_filters.filter_urls(pages(spark, [(1, "http://x.org/", None)]), rules.limit(0), default="block").first()
    assert (got["rule"], got["verdict"]) == (None, "block")


# WARC


def test_arc_reader_and_converter():
    records = [{"url": f"http://x.org/a b{i}", "ip": "1.2.3.4", "date": "19970101120000", "content_type": "text/html", "block": b"HTTP/1.0 200 OK\r\n\r\n" + b"x\n" * i} for i in range(3)]
    records.append({"url": "dns:x.org", "ip": "1.2.3.4", "date": "1997", "content_type": "text/dns", "block": b"x.org. 1 IN A 1.2.3.4"})
    for version in (1, 2):
        data = warc.arc_bytes(records, version)
        got = list(warc.read_arc(io.BytesIO(data)))
        assert [b for _, b in got[1:]] == [r["block"] for r in records] and got[1][0]["URL"] == "http://x.org/a%20b0"
        made = [warc.convert(h, b) for h, b in got]
        assert [m["type"] for m in made] == ["warcinfo", "response", "response", "response", "resource"]
        assert made[1]["date"] == "1997-01-01T12:00:00Z" and made[4]["date"] == "1997-01-01T00:00:00Z"
        assert made[2]["payload_digest"] == hashlib.sha1(b"x\n").hexdigest()
        assert len({m["record_id"] for m in made}) == 5
        back = list(warc.read_warc(io.BytesIO(b"".join(map(warc.warc_record, made)))))
        assert [b for _, b in back] == [b for _, b in got]
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(data[:-4])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"only three fields\nx")))


def test_archives_round_trip(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1</p>" * 100, "y" * 999
    some = [(1, "http://a.org/", big), (2, None, big), (3, "http://b c/", big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (9, "u", "z" * 200_000), (9, "u", "z" * 200_000), (None, "u", big), (8, "u", "y" * 1000), (10, "u", "y" * 1000)]
    got = rows(warc.archive_pages(pages(spark, some, CLASH)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    want = []
    for i, _, h in some:
        b = (h or "").encode()
        top = max((j for j, _, g in some if (g or "") == (h or "") and j is not None), default=None)
        revisit = len(b) >= 1000 and i is not None and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_archives_are_warc(spark, tmp_path):
    """Any gzip reader sees a warcinfo record and then each record; a revisit names the record it refers to; no identifier comes twice."""
    import gzip

    big = "<p>x</p>" * 200
    some = [(1, "http://a.org/", big), (2, "http://b.org/", big), (3, "http://c.org/", "é"), (3, "http://c.org/", "é"), (4, None, None)]
    path = str(tmp_path / "w")
    got = {r["record_id"]: r for r in warc.archive_pages(pages(spark, some).coalesce(1), path=path).collect()}
    assert len(got) == len(some)
    revisit = next(r for r in got.values() if r["record_type"] == "revisit")
    assert got[revisit["refers_to_record"]]["page_id"] == revisit["refers_to"] == 2
    assert sorted(r["page_id"] for r in warc.read_warcs(spark, path).collect()) == [1, 2, 3, 3, 4]  # read as any other archive
    kinds = []
    for f in (tmp_path / "w").glob("part-*"):
        records = list(warc.read_warc(io.BytesIO(gzip.decompress(f.read_bytes()))))
        kinds += [h["WARC-Type"] for h, _ in records]
        for h, block in records:
            if h["WARC-Type"] == "revisit":
                assert h["WARC-Refers-To"] == revisit["refers_to_record"] and h["WARC-Refers-To-Target-URI"] == "http://b.org/" and h["WARC-Refers-To-Date"].endswith("Z") and block.endswith(b"\r\n\r\n")
        assert f.read_bytes().count(b"\x1f\x8b\x08") >= 2 * len(records)  # each record is a member, and so is what stands between
    assert kinds[0] == "warcinfo" and sorted(kinds) == ["response"] * 4 + ["revisit", "warcinfo"]
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_converting_stored_archives(spark):
    block = b"HTTP/1.0 200 OK\r\n\r\nhello"
    data = bytearray(warc.arc_bytes([{"url": "http://x/", "ip": "0.0.0.0", "date": "19990101000000", "content_type": "text/html", "block": block}], 2))
    table = spark.createDataFrame([(data,), (None,), (bytearray(),)], "content binary")
    got = warc.convert_arcs(table).collect()
    assert len(got) == 1 and bytes(got[0]["block"]) == block and got[0]["payload_bytes"] == 5


# Nearest neighbours


def vectors(spark, some, extra=()):
    return spark.createDataFrame([(i, v, *("x" for _ in extra)) for i, v in some], "vec_id long, embedding array<float>" + "".join(f", {c} string" for c in extra))


def slow_nearest(some, k=20):
    out = {}
    for i, q in some:
        if i % 20 == 0:
            scored = sorted((-float(np.dot(np.float64(np.float32(q)), np.float64(np.float32(v)))), j) for j, v in some if j != i)
            out[i] = [j for _, j in scored[:k]]
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    some = [(i, [float(x) for x in v * (1 + i % 3)]) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    got, vec = {}, dict(some)
    for r in ann.nearest(vectors(spark, some, ("id", "v", "score", "rank"))).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
        exact = float(np.dot(np.float64(np.float32(vec[r["query_id"]])), np.float64(np.float32(vec[r["vec_id"]]))))
        assert r["score"] == pytest.approx(exact, rel=1e-12)
    want = slow_nearest(some)
    assert set(got) == set(want)
    assert sum(len(set(want[i]) & {r["vec_id"] for r in got[i]}) for i in want) >= 0.9 * 20 * len(want)
    for rs in got.values():
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)


def recall(spark, some, **options):
    got = {}
    for r in ann.nearest(vectors(spark, some), **options).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = slow_nearest(some)
    return sum(len(set(want[i]) & got.get(i, set())) for i in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["plain", "unit", "lognormal", "clustered", "wide", "copies"])
def test_recall_on_vectors_of_every_kind(spark, monkeypatch, kind):
    """Several cells, blocks and slices of queries; unit vectors of 384 dimensions are as hard as any."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 384 if kind == "wide" else 24))
    if kind in ("unit", "wide", "lognormal"):
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    if kind == "lognormal":
        x *= rng.lognormal(0, 1, (len(x), 1))
    if kind == "clustered":
        x = 3 * x[rng.integers(0, 12, len(x))] + 0.4 * x
    if kind == "copies":
        x[::3] = x[0]
    some = [(i, [float(v) for v in row]) for i, row in enumerate(np.float32(x))]
    monkeypatch.setattr(ann, "BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    monkeypatch.setattr(ann, "SAMPLE", 400)
    assert recall(spark, some) >= 0.95
    if kind in ("plain", "copies"):
        assert recall(spark, some, exact=True) == 1


def test_cells_that_hold_nothing_better_are_left_out():
    rng = np.random.default_rng(5)
    near, far = np.float64([[10.0, 0], [9, 1], [8, 0]]), np.float64([[-10.0, 0], [-9, 1]])
    sample = np.concatenate([near, rng.standard_normal((20, 2))])
    c = np.float64([[1.0, 0], [-1, 0]])
    run = ann._route(np.arange(len(sample)), sample, c, [(0, 0.2, 10.0, 8.0), (1, 0.2, 10.0, 8.0)], 2, 2)
    q = ann.pa.RecordBatch.from_arrays([ann.pa.array([100]), ann.pa.array([[1.0, 0.0]])], names=["id", "v"])
    assert [b.column(2).to_pylist() for b in run([q])] == [[0]] and len(far)


def test_nearest_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    some = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (20, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (9, [0.5, 0.5]), (40, [0.0, -1.0]), (0, [1.0, 0.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors(spark, some)).collect())
    assert [g for g in got if g[0] == 20] == [(20, 1, 0), (20, 2, 0), (20, 3, 8), (20, 4, 9), (20, 5, 40)]
    assert [g[2] for g in got if g[0] == 0] == [20, 8, 9, 40]
    assert ann.nearest(vectors(spark, [])).count() == 0 and ann.nearest(vectors(spark, [(1, None)])).count() == 0


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="page">
<header><a href="/">Site</a></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><article class="post"><h1>Title {i}</h1><p>First &amp; <b>bold</b><br>line {i}<p>Second&nbsp;&eacute; {i}</p>{extra}<div class="ad">Buy {i}</div><form><input name=q><button>Go</button></form></article>
<aside>Side {i}</aside><section class="comments"><p>Troll {i}</p></section></div><footer>&copy; {i}</footer>{end}"""


def page(i):
    return PAGE.format(i=i, menu="".join(f"<li><a href=x>{k}</a></li>" for k in range(i % 4)), extra="<ul><li>a<li>b</ul>" if i % 2 else "", end="" if i % 3 else "</body></html>")


def want_text(i):
    return "\n\n".join([f"Title {i}", f"First & bold line {i}", f"Second é {i}", *(["a", "b"] if i % 2 else [])])


def test_articles_of_a_host(spark):
    some = [(i, f"http://host.org/{i}", page(i)) for i in range(150)] + [(1000, "http://alone.org/", page(3)), (1001, None, page(4)), (1002, "x", None), (1003, "http://host.org/e", ""), (1, "http://host.org/1", page(1))]
    got = wrappers.extract_pages(pages(spark, some, CLASH)).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([(i, want_text(i)) for i in [*range(150), 1]] + [(1000, want_text(3)), (1001, want_text(4)), (1002, ""), (1003, "")])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrappers.extract_pages(pages(spark, [])).count() == 0


def test_pages_without_an_article_element():
    body = "<body><div class=top><span>Menu</span></div><div class=box><div><p>{0} one two three four five</p><p>{0} six seven eight</p></div></div><div class=foot>Imprint</div></body>"
    trees = [wrappers.parse(body.format(w)) for w in ("alpha", "beta", "gamma", "delta")]
    wrapper = wrappers.infer(trees)
    assert wrappers.extract(trees[1], wrapper) == ["beta one two three four five", "beta six seven eight"]
    assert "(<p>#text</>)+" in str(wrapper) and "'Menu'" in str(wrapper)


def test_wrapper_has_optional_and_repeated_groups():
    trees = [wrappers.parse(f"<body><h1>{i}</h1>{'<div>x</div>' * (i == 1)}{'<p>y</p>' * (i + 1)}</body>") for i in range(3)]
    assert str(wrappers.infer(trees)) == "<#page><body><h1>#text</> (<div>'x'</>)? (<p>'y'</>)+</></>"
    lists = [wrappers.parse("<dl>" + "<dt>a<dd>b" * n + "</dl>") for n in (1, 3)]
    assert str(wrappers.infer(lists)) == "<#page><dl>(<dt>'a'</> <dd>'b'</>)+</></>"


def alone(text):
    events = wrappers.parse(text)
    return wrappers.extract(events, wrappers.infer([events]))


def test_real_prose_is_kept():
    assert alone('<article><p>one two</p><p class="side-effects">Real prose</p><p class="search-results">More prose</p></article>') == ["one two", "Real prose", "More prose"]
    assert alone('<body><div class="social"><p>All the text is here</p></div></body>') == ["All the text is here"]
    assert alone("<article><header><p>By A</p></header><h1>T</h1><p>x</p></article>") == ["T", "x"]
    assert alone("<body>" + "<nav>" * 160 + "menu" + "</nav>" * 160 + "<p>body</p></body>") == ["body"]
    assert alone("<body>" + "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "</body>") == ["deep"]
    assert alone('<p title="a > b">x</p><p title=\'c\'d>y</p><p it\'s>z</p>') == ["x", "y", "z"]
    assert alone("<form><main><p>a page in a form</p></main></form>") == ["a page in a form"]


def plain_page(i, words):
    """A page whose tags say nothing: only its host tells the article from the rest."""
    text = [" ".join(words[j] for j in range(i + k, i + k + 12)) for k in (0, 40, 80)]
    return text, "<body><div><a href=/>Home of all</a> <a href=/x>Topics</a></div><div><h3>Read every day</h3></div><section>" + "".join(f"<p>{t}</p>" for t in text) + "<h5>Share this page</h5></section><div><p>All rights are with the publisher of this site, whose name is long</p></div></body>"


def test_alignment_decides_where_tags_say_nothing():
    """Pages aligned with their host are read right; the same pages alone are not."""
    rng = np.random.default_rng(0)
    words = [f"word{x}" for x in rng.integers(0, 10**6, 400)]
    made = [plain_page(i, words) for i in range(30)]
    trees = [wrappers.parse(h) for _, h in made]
    wrapper = wrappers.infer(trees)
    together = sum(wrappers.extract(t, wrapper) == text for t, (text, _) in zip(trees, made, strict=True))
    single = sum(alone(h) == text for text, h in made)
    assert together == 30 and single == 0


def test_merged_wrappers_equal_one_of_all_pages():
    trees = [wrappers.parse(page(i)) for i in range(12)]
    whole = wrappers.infer(trees)
    parts = []
    for at in range(0, 12, 4):
        part = wrappers.Group("#page")
        for t in trees[at : at + 4]:
            wrappers.align(part, t)
        parts.append(wrappers.load(wrappers.dump(part)))
    for p in parts[1:]:
        wrappers.merge(parts[0], p)
    assert str(wrappers.complete(parts[0])) == str(whole) and [g.label for g in wrappers.article(parts[0])] == [g.label for g in wrappers.article(whole)]


def test_hostile_markup():
    for text in ("<", "<p", "<p>a<", "</p></p>x", "<div>" * 5000 + "deep", "<script>never closed <p>x", "<!-- open", "a" * 300_000, "<p " + "x" * 10_000, "&#0;&#xFFFFFFF;&bogus;", "<b><i>x</b></i>y", "<svg>" * 9, "<![CDATA[ x", "<?x"):
        alone(text)
    assert alone("<p>a < b &lt; c</p>") == ["a < b < c"]


@pytest.mark.parametrize("text", ['<a "' * 250_000, '<a b="' * 160_000, "<dl>" + "<dt>x<dd>y" * 90_000, "<section>" * 50_000 + "<li></li>" * 50_000, "<div>" * 90_000 + "</foo>" * 90_000, "".join(f"<p class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}>x" for i in range(50_000))])
def test_a_hostile_megabyte_takes_seconds(text):
    import time

    began = time.process_time()
    alone(text)
    assert time.process_time() - began < 15


# Pipeline


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_documents import ITEMS, PATH, PLANTED, lang_rows, near_rows, slow_hits, stays

    from waymark.llm import packing

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    some = [(5000 + i, t, lang) for i, t, lang in lang_rows()] + [(i, t) for i, t in near_rows() if i >= 100] + [(9000 + i, t) for i, (_, t) in enumerate(PLANTED)]
    docs(spark, some).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from waymark.llm import langid

    led = {r["doc_id"] for r in langid.predictions(docs(spark, some)).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert len(led) > 100
    left = stays([r[:2] for r in some if r[0] in led])
    left = {i: t for i, t in left if not slow_hits(t, ITEMS)[4]}
    e = packing.encoder(PATH).tokenizer
    want = {i: len(e.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    sums = {}
    for r in got:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
    assert sums == want


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_documents import CLASH, ITEMS, ODD, lang_rows

    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = (*CLASH, "_lang_pred", "_score", "rid ", "place")
    for some in ([], ODD + lang_rows() + [(None, None), (None, "")]):
        given = docs(spark, some, extra)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == given.columns and out.dtypes == given.dtypes
            assert all(r[c] == "x" for r in out.collect() for c in extra)
            given = out
        assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() >= 0
