"""The training-corpus operators against brute force, libraries, exact round trips and their SQL, and on awkward input."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chunks, decontam, htmltext, iblt, langid, licenses, merging, minhash, pieces, queries, token_counts, token_files, warc

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = ("documents", "benchmark", "pages")


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, None, "s", None) for k, t in enumerate(texts)], DOCS)


def clashing(df):
    """With extra columns of names that operators may use inside."""
    for c in ("text_", "t", "k", "_next", "digest", "band", "id", "component", "s", "score"):
        df = df.withColumn(c, F.lit("x"))
    return df


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


AWKWARD = [None, "", " ", "\n\n", "one", "one two", "é ü\n日本", "x" * 30_000, "a b " * 9000, "one two", None, "The End.", "<|endoftext|> a", "\x00\x01", "tab\tand\r\nline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    made = queries.queries()[name](spark, DIR).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(made.columns) == cols
    as_rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert as_rows(made) == as_rows(want)


# 1. fingerprints


def pieces_of(t):
    return {p.rstrip(" ") for p in re.findall(rf"(?:[^\s]++[^\S\n]*+){{1,{iblt.PIECE}}}+", t, re.A)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(rows, texts):
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(pieces_of(t), pieces_of(edited)))
        assert r["near_next"] == pytest.approx(jaccard(pieces_of(t), pieces_of(after)))


def test_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    check_fingerprints({r["doc_id"]: r for r in iblt.fingerprints(docs).collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})


def test_fingerprints_of_awkward_texts(spark):
    rng = random.Random(1)
    texts = [*AWKWARD, "\n".join(words(rng, 20) for _ in range(3000))]
    rows = {r["doc_id"]: r for r in iblt.fingerprints(clashing(docs_of(spark, texts))).collect()}
    check_fingerprints(rows, dict(enumerate(texts)))
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[5]["fingerprint"] == rows[9]["fingerprint"] != rows[4]["fingerprint"]
    assert iblt.fingerprints(docs_of(spark, ["alone"])).first()["near_next"] == 1
    assert iblt.fingerprints(docs_of(spark, ["x"]).limit(0)).count() == 0
    odd = docs_of(spark, ["a", "b"]).unionByName(spark.createDataFrame([(None, "n", None, None, None), (1, "b", None, None, None)], DOCS))
    assert iblt.fingerprints(odd).count() == 4


def test_digests_that_no_retry_resolves_are_compared_as_sets(spark):
    rng = random.Random(2)
    shared, x, y = (rng.sample(range(1 << 40), 400) for _ in range(3))
    df = spark.createDataFrame([(shared + x, shared + y)], "l array<bigint>, r array<bigint>").selectExpr(*(f"transform({c}, d -> {iblt._checked('d')}) as {c}" for c in "lr"))
    first = iblt.subtract(iblt.sketch("l"), iblt.sketch("r"))
    for retries in (0, 1, iblt.RETRIES):
        assert iblt.differing(df, "l", "r", first, "n", retries).first()["n"] == 800


def test_a_fingerprint_begins_with_its_number_of_paragraphs(spark):
    made = iblt.fingerprint(docs_of(spark, ["one\ntwo\none", None])).collect()
    assert [int(r["fingerprint"][:16], 16) for r in made] == [2, 0] and all(len(r["fingerprint"]) == 16 * (1 + iblt.CELLS) for r in made)


# 2. decontamination


def brute_contamination(texts, items, size=13):
    out = {}
    for i, t in texts.items():
        w, hit, found = decontam.words_of(t), set(), set()
        for item, text in items.items():
            for run in decontam.windows(decontam.words_of(text), size):
                for k in range(len(w) - len(run) + 1):
                    if w[k : k + len(run)] == run:
                        hit.update(range(k, k + len(run)))
                        found.add(item)
        close = 0
        for text in items.values():
            q = decontam.words_of(text)
            close += bool(q) and any(set(q) <= set(w[k : k + decontam.NEAR * len(q)]) for k in range(len(w)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), close)
    return out


def test_contamination_equals_brute_force_in_one_or_several_blocks(spark):
    rng = random.Random(3)
    items = {k: words(rng, n, 30) for k, n in enumerate([20, 13, 12, 3, 1, 40, 40])} | {7: None, 8: "", 9: " ,. ", 10: "W1 w2"}
    texts = dict(enumerate([*AWKWARD, *(words(rng, 60, 30) for _ in range(40))]))
    for k in range(len(AWKWARD), len(texts), 3):
        texts[k] += " ... " + (items[k % 7] or "").upper()
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    index = decontam.store_index(clashing(docs_of(spark, texts.values())), segment_tokens=300)
    want = brute_contamination(texts, items)
    for limit in (1 << 20, 60):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontam.report(decontam.contamination(index, bench, query_bytes=limit)).collect()}
        assert got == want
    assert decontam.decontaminate(docs_of(spark, ["a"]), bench.limit(0)).first()["n_items"] == 0
    assert decontam.decontaminate(docs_of(spark, ["a"]).limit(0), bench).count() == 0


def test_null_ids_stay_null_and_each_row_has_its_own_result(spark):
    rng = random.Random(11)
    bad, clean = words(rng, 20), words(rng, 30)
    bench = spark.createDataFrame([(0, bad), (1, words(rng, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(None, bad), (-1, clean), (None, clean), (5, bad), (5, clean), (0, clean), (None, None)], "doc_id long, text string")
    for limit in (1 << 20, 60):
        hits = decontam.report(decontam.contamination(decontam.store_index(docs), bench, query_bytes=limit)).collect()
        assert sorted(((r["doc_id"], r["contaminated"]) for r in hits), key=str) == sorted([(None, True), (-1, False), (None, False), (5, True), (5, False), (0, False), (None, False)], key=str)
    kept = decontam.without_contaminated(docs, bench).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(-1, clean), (None, clean), (5, clean), (0, clean), (None, None)], key=str)


def test_hits_of_a_block_are_stored_before_the_next_block_is_made(spark, monkeypatch):
    rng = random.Random(12)
    bench = spark.createDataFrame([(k, words(rng, 20)) for k in range(12)], "item_id long, text string")
    index = decontam.store_index(docs_of(spark, [words(rng, 50)]))
    steps, phrases, written = [], decontam.Phrases, decontam.written
    monkeypatch.setattr(decontam, "Phrases", lambda p, *shared: (shared or steps.append("made")) and None or phrases(p, *shared))
    monkeypatch.setattr(decontam, "written", lambda *a: steps.append("stored") or written(*a))
    assert decontam.contamination(index, bench, query_bytes=200).count() == 1
    assert len(steps) > 4 and steps == ["made", "stored"] * (len(steps) // 2)


def test_phrases_and_proximity_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [words(rng, 50, 12) for _ in range(25)]
    tests = spark.createDataFrame([(0, "w1 w2"), (1, "w3"), (2, "w4 w5 w6"), (3, "w7 w7")], "item_id long, text string")
    index = decontam.store_index(docs_of(spark, texts), segment_tokens=120)
    want, near = set(), set()
    for i, t in enumerate(texts):
        w = t.split()
        for item, q in ((0, "w1 w2"), (1, "w3"), (2, "w4 w5 w6"), (3, "w7 w7")):
            q = q.split()
            want |= {(item, i, k, len(q)) for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q}
            for a in range(len(w)):
                for b in range(a, min(len(w), a + 6)):
                    if set(q) <= set(w[a : b + 1]) and not set(q) <= set(w[a + 1 : b + 1]) and not set(q) <= set(w[a:b]):
                        near.add((item, i, a, b - a + 1))
    assert {tuple(r) for r in decontam.phrase_matches(index, tests).collect()} == want
    assert {tuple(r) for r in decontam.proximity_matches(index, tests, 6).collect()} == near


# 3. pages


def test_common_lines_is_longest(monkeypatch):
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        for cells in (1 << 28, 8):
            monkeypatch.setattr(htmltext, "CELLS", cells)
            found = sorted(htmltext.common_lines(a, b))
            rest = iter(b)
            assert len(found) == d[-1][-1] and all(a[k] in rest for k in found)


def test_long_and_deep_pages_take_little_time():
    import time

    began = time.process_time()
    deep = "<p><table><tr><td>" + "<div>" * 20_000 + "x" + "</span></li>" * 2000 + "<p>y</p>" * 2000
    assert len(htmltext.page_lines(deep)) == 2001
    r = random.Random(4)
    two, other = ([r.choice("ab") for _ in range(4000)] for _ in range(2))
    assert len(htmltext.common_lines(two, other)) > 2500
    assert time.process_time() - began < 5


def test_main_text_of_marked_and_unmarked_pages(spark):
    template = "<html><head><title>t</title><style>x</style></head><body><p>Site name</p>{}<p>All rights</p></body></html>"
    pages = [
        (1, "http://h/a/1", template.format("<p>One &amp; only &lt;b&gt;</p><div class='ad'>buy</div>")),
        (2, "http://h/a/2", template.format("<p>Two\n  words<br>more</p><form>f</form>")),
        (3, "http://h/b/1", "<body><header>h</header><main><h1>T</h1><p>Site name<p>x<section id=comments><p>no</section></main><p>out</body>"),
        (4, None, None), (5, "http://other/", ""), (6, "bad url", "<p>kept"), (6, "bad url", "<p>kept"),
    ]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.main_text(clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect())
    text = dict((k, t) for k, t, _ in got)
    assert text[1] == "One & only <b>" and text[2] == "Two words\nmore" and text[3] == "T\nSite name\nx\nout" and text[4] == text[5] == ""
    assert all(len(t) == n for _, t, n in got) and len(got) == 7
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layout_classes_forms_and_words_in_articles_keep_their_text():
    """Expectations by hand."""
    pages = {
        '<div class="layout has-sidebar"><article><p>Body text one.': "Body text one.",
        '<div id="page" class="header-fixed"><main><p>Body text two.': "Body text two.",
        '<form id="aspnetForm"><article><p>Body text three.</form>': "Body text three.",
        '<body class="no-comments sidebar"><div class="site-header">Logo</div><article><h1>T</h1><p>Body.</p></article><div class="sidebar-right">Side</div><div class="footer">F</div>': "T\nBody.",
        '<article><h2 id="related-work">Related work</h2><p id="banner-ads">On ads.</p><div class="reply-to"><p>Kept.</p></div><div class="ad">Buy</div><div class="comments"><p>First!</p></div></article>': "Related work\nOn ads.\nKept.",
        '<main><p>The article is long enough here.</p><div class="related"><article><p>Teaser</p></article></div><aside><article><p>Side</p></article></aside></main>': "The article is long enough here.",
        '<main><article><p>Short.</p></article><div id="comments"><article class="c"><p>A comment that is far longer than the article.</p></article></div></main>': "Short.",
        '<main><form action="/x"><article><p>In a form.</p><form><p>Mail us</p></form></article></form></main>': "In a form.",
        '<header><div class="wrap"><main><p>Main in a header.</p></main></div></header><nav>N</nav>': "Main in a header.",
        '<div class="comment-policy"><p>Our policy.</p></div><div class="promo-box">Buy</div><p>Text</p>': "Text",
        '<div class="is-menu-open"><p>No mark at all.</p></div>': "No mark at all.",
    }
    for page, want in pages.items():
        assert htmltext.article(htmltext.page_lines(page), None) == want, page


def test_pages_without_an_end_of_head_keep_their_text(spark):
    heads = ["<head><title>t</title><meta charset=utf-8>", "<head><script>x</script><noscript><link href=x>", "<head><title>t</title></head>", "<title>t</title>"]
    for head in heads:
        assert [x.text for x in htmltext.page_lines(f"<html>{head}<body><p>One<p>two</body></html>")] == ["One", "two"]
    assert [x.text for x in htmltext.page_lines("<head><title>t</title>\n<div>One</div><p>two")] == ["One", "two"]
    assert [x.text for x in htmltext.page_lines("<head><style>x</style> One<template><p>no</p></template>")] == ["One"]
    pages = spark.createDataFrame([(1, "http://h/1", "<html><head><title>t</title><body><p>One</p></body></html>")], "page_id long, url string, html string")
    assert htmltext.main_text(pages).first()["text"] == "One"
    assert warc.derivatives(warc.responses(pages)).where("warc_type = 'conversion'").first()["block"] == b"One"


def test_differencing_skips_twins_and_does_not_depend_on_ranges(spark):
    rng = random.Random(8)
    page = lambda *own: "<html><head></head><body><p>Site</p>" + "".join(f"<p>{x}</p>" for x in own) + "<p>Rights</p></body></html>"
    rows = [(1, "http://t/a", page("A")), (2, "http://t/a", page("A")), (3, "http://t/b", page("B")), (4, "http://u/a", page("only")), (5, "http://u/b", page("only"))]
    rows += [(6, "http://t/c", page("C")), (7, "http://t/c2", page("C").replace("<p>C", "<p class=ad>C")), (8, "http://v/x", None), (9, None, page("N"))]
    rows += [(10 + k, f"http://w/{rng.randrange(30)}", page(f"own {rng.randrange(6)}", "more")) for k in range(60)]
    rows += [(100 + k, "http://x/hot", page("hot")) for k in range(40)] + [(200, "http://x/last", page("last"))]

    # Brute force: the order of all pages, the nearest pages of the host on either side that have other lines.
    split = {k: re.match(r"\w+://([^/]*)(.*)", u or "") for k, u, _ in rows}
    held = sorted(((m[1], m[2]) if (m := split[k]) else ("", ""), k, h) for k, u, h in rows)
    lines = [htmltext.page_lines(h) for _, _, h in held]
    texts = [[x.text for x in p] for p in lines]
    want = {}
    for i, ((host, path), k, _) in enumerate(held):
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(held) and held[j][0][0] == host and texts[j] == texts[i]:
                j += step
            if 0 <= j < len(held) and held[j][0][0] == host:
                near.append(j)
        # After a run of twins its first page counts, before one its last: that is the nearest one.
        j = max(near, key=lambda j: htmltext._prefix(held[j][0][1], path), default=None)
        want[k] = (htmltext.article(lines[i], None if j is None else lines[j]), None if j is None else held[j][1])
    assert want[1][0] == want[2][0] == "A" and want[3][0] == "B" and want[4][0] == "Site\nonly\nRights" and want[100][0] == "hot" and want[7][0] == ""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 2, 13, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = htmltext.main_text(pages.repartition(3)).collect()
            assert len(got) == len(rows) and {r["page_id"]: (r["text"], r["partner"]) for r in got} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_main_text_equals_the_pages_articles(spark):
    import html

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


# 4, 9. tokens


def test_elias_fano():
    r = random.Random(5)
    for _ in range(60):
        v = np.sort(np.array([r.randrange(10 ** r.randint(1, 12)) for _ in range(r.randint(1, 900))]))
        e = token_files.EliasFano.read(memoryview(token_files.EliasFano.of(v).to_bytes()))
        a, b = sorted((r.randrange(len(v) + 1), r.randrange(len(v) + 1)))
        assert (e.some(0, len(v)) == v).all() and (e.some(a, b) == v[a:b]).all() and all(e[i] == v[i] for i in range(0, len(v), 53))
    assert len(token_files.EliasFano.read(memoryview(token_files.EliasFano.of(np.zeros(0)).to_bytes())).some(0, 9)) == 0


def test_very_many_empty_documents_close_blocks_by_their_number(spark, tmp_path):
    docs = spark.range(0, 5000, 1, 1).selectExpr("id * id * 1000003 as doc_id", "if(id % 7 = 0, null, '') as text")
    token_files.write_tokens(docs, str(tmp_path / "out"), block_docs=300)
    held = [b.n_docs for p in sorted((tmp_path / "out").glob("*.txt")) for b in token_files.blocks(p.read_bytes())]
    assert sum(held) == 5000 and max(held) == 300
    got = token_files.read_tokens(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(k * k * 1000003, k, 1) for k in range(5000)]


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_counts.default_tokenizer())
    rng = random.Random(6)
    parts = ["a", "ab", " ", "  ", "   ", "\n", "\n\n", "é", "日本", "🙂", "\t", "the", "ing", "<|endoftext|>", "'s", "--", "1", "\r\n", "\x85", "\xa0", "\u3000"]
    mixed = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800))
    texts = {-3: "first", 2**40: "far"} | {100 + k: t for k, t in enumerate([*AWKWARD, *(words(rng, 80) for _ in range(40)), *mixed])}
    docs = clashing(spark.createDataFrame([(k, t, None, "s", None) for k, t in texts.items()], DOCS)).repartition(3)
    token_files.write_tokens(docs, str(tmp_path / "out"), block_ids=500)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(spark, str(tmp_path / "out")).collect()}
    start = 0
    for k in sorted(texts):
        ids = [*tk.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = [p.read_bytes() for p in sorted((tmp_path / "out").glob("*.txt"))]
    one = next(b for f in files for b in token_files.blocks(f))
    assert one.document(0).tolist()[-1] == 2
    odd = spark.createDataFrame([(None, "n", None, None, None), (1, "b", None, None, None), (1, "b", None, None, None)], DOCS)
    assert sorted((r["doc_id"] or -1) for r in token_files.token_table(odd).collect()) == [-1, 1, 1]
    assert token_files.token_table(odd.limit(0)).count() == 0


def test_rows_of_one_key_are_dealt_to_many_files(spark, tmp_path):
    docs = spark.range(0, 3000, 1, 3).selectExpr("if(id % 3 = 0, null, 7) as doc_id", "concat('w', id) as text")
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        token_files.write_tokens(docs, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [[b.n_docs for b in token_files.blocks(p.read_bytes())] for p in sorted((tmp_path / "out").glob("*.txt"))]
    assert len(files) >= 6 and max(map(sum, files)) < 900 and sum(map(sum, files)) == 3000
    got = token_files.read_tokens(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 1000 + [7] * 2000
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_counts.default_tokenizer())
    rng = random.Random(7)
    parts = ["a", "ab", " ", "  ", "   ", "\n", "é", "日本", "🙂", "\t", "the", "ing", "<|endoftext|>", "<|", "'s", "--", "1", "\r\n", "\x85", "\xa0", "　"]
    texts = [*AWKWARD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400))]
    for r in token_counts.count_tokens(clashing(docs_of(spark, texts))).collect():
        t = texts[r["doc_id"]] or ""
        n = len(tk.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert all("".join(chunks.space_chunks(t)) == t for t in texts if t)


def test_merge_rounds_equal_single_merges_for_any_table():
    rng = np.random.default_rng(8)
    for _ in range(60):
        left, right = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
        keep = rng.random(36) < 0.6
        rank, into = rng.integers(0, keep.sum(), keep.sum()), rng.integers(0, 6, keep.sum())
        table = merging.MergeTable(left[keep], right[keep], rank, into, 6)
        pairs = {(a, b): (r, m) for a, b, r, m in zip(left[keep].tolist(), right[keep].tolist(), rank.tolist(), into.tolist(), strict=True)}
        lengths = rng.integers(1, 30, 5)
        sym = rng.integers(0, 6, lengths.sum())
        out, counts = merging.merge(table, sym, lengths)
        want = []
        for w in np.split(sym, np.cumsum(lengths)[:-1]):
            w = w.tolist()
            while found := [(pairs[p][0], k) for k, p in enumerate(zip(w, w[1:], strict=False)) if p in pairs]:
                _, k = min(found)
                w[k : k + 2] = [pairs[w[k], w[k + 1]][1]]
            want.append(w)
        assert counts.tolist() == [len(w) for w in want] and out.tolist() == [x for w in want for x in w]


def test_chunks_of_many_texts_are_those_of_each():
    import pyarrow as pa

    rng = random.Random(17)
    parts = ["a", "bc", " ", "  ", "\n", "\n\n", "é", "\t", "<|x|>", "\x85", "\xa0", "\u3000", "\r\n"]
    texts = [None, "", " ", "\n", "\n\n", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(600))]
    for special in ([], ["<|x|>"]):
        distinct, codes, bounds = chunks.chunked(pa.array(texts, pa.string()), special)
        for k, t in enumerate(texts):
            made = [distinct[c] for c in codes[bounds[k] : bounds[k + 1]] if distinct[c]]
            assert "".join(made) == (t or "")
            if not special or "<|x|>" not in (t or ""):
                assert made == chunks.space_chunks(t or "")
            else:
                assert made.count("<|x|>") == t.count("<|x|>")


# 5. pieces


def test_pieces_equal_the_library(spark):
    rng = random.Random(9)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "日本", "🙂", "the", "ing", "<s>", "<0x41>", "ａ", "===", "    ", "1", "\r\n"]
    texts = [*AWKWARD, "=" * 4001, "  a", "▁▁ ▁x", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.digests(clashing(docs_of(spark, texts))).collect()}
    assert [got[k] for k in range(len(texts))] == pieces.brute_force(texts)
    assert pieces.digests(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_decoding_of_any_ids_equals_the_library():
    import sentencepiece

    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), pieces.PieceModel(pieces.default_model()), random.Random(10)
    for _ in range(300):
        x = [rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(20)]
        assert model.decode(np.array(x)) == sp.decode(x)


# 6. near-duplicates


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(minhash._LOWER).split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("size", "block"), [(2, 16), (5, 16), (2, 3)])
def test_near_duplicates_equal_brute_force(spark, size, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)  # so that a group has many blocks
    rng = random.Random(11)
    base = [words(rng, 120) for _ in range(4)]
    texts = [*AWKWARD, *(edited(rng, base[0], rng.randrange(0, 13)) for _ in range(150)), *(edited(rng, b, rng.randrange(0, 9)) for b in base for _ in range(12)), *([base[1]] * 20), *(words(rng, 50) for _ in range(40))]
    rng.shuffle(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(clashing(docs_of(spark, texts)), size, 80).collect()}
    assert got == brute_components(dict(enumerate(texts)), size, 80)


def test_near_duplicates_with_a_hot_group_use_no_broadcast(spark, tmp_path):
    """A third of all rows near copies, another sixth unlike texts with a common passage, over many partitions."""
    rng = random.Random(12)
    base, passage = words(rng, 100), words(rng, 30)
    texts = [*(edited(rng, base, rng.randrange(0, 9)) for _ in range(200)), *(passage + " " + words(rng, 40) for _ in range(100)), *(words(rng, 60) for _ in range(300))]
    rng.shuffle(texts)
    docs = docs_of(spark, texts)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        made = minhash.near_duplicates(docs.repartition(64), 2, 80)
        got = {r["doc_id"]: tuple(r)[1:] for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_components(dict(enumerate(texts)), 2, 80)
    assert "Broadcast" not in plan


def test_members_of_a_large_bucket_meet_in_rows_that_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    made = []
    for n in (200, 400):
        # Two thirds are of one component, the others of their own; a small bucket beside them is one block.
        near = spark.createDataFrame([(1, k, 0 if k % 3 else k) for k in range(1, n)] + [(2, 9001, 0), (2, 9002, 0), (2, 9003, 9003)], "band long, id long, component long")
        rows = minhash._meetings(near).collect()
        assert sorted((r["id"], r["asks"]) for r in rows if r["band"] == 2) == [(9001, 0), (9002, 0), (9003, 2)]
        blocks = {}
        for r in rows:
            if r["band"] == 1:
                blocks.setdefault((r["p"], r["q"]), ([], []))[r["asks"]].append((r["id"], r["component"]))
        met = [(a, b) for asked, ask in blocks.values() for a, x in ask for b, y in asked if x != y]
        assert len(met) == len(set(met)) and set(met) == {(a, b) for a in range(3, n, 3) for b in range(1, n) if a != b}
        made.append(len(rows))
    assert made[1] <= 2.1 * made[0]  # with as many blocks as the bucket has eights: four times


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c", None, None, None), (1, "a b c", None, None, None), (1, "a b c", None, None, None), (2, None, None, None, None)], DOCS)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(odd, 2).collect())
    assert got == [(-1, -1, False), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_rows_of_one_id_with_two_texts_link_what_is_like_either(spark):
    rng = random.Random(13)
    a, b = words(rng, 200), words(rng, 200)
    rows = [(1, a), (2, edited(rng, a, 3)), (2, edited(rng, b, 3)), (3, b), (3, b), (4, words(rng, 50)), (None, a), (0, None), (0, ""), (9, edited(rng, a, 3)), (9, words(rng, 90))]
    for n in (1, 7):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), 5).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (9, 1, False), (9, 1, False)]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (300, 301)]
    got = dict(tuple(r) for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {301: 300}


# 7. licences


def test_licences_and_inheritance(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "plain"), (3, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."), (4, "d/y.txt", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (5, "d/z.txt", None), (6, None, "Released under the MIT License."), (7, "a/z.txt", "All about a licence that nobody knows of, with many words"),
    ]
    got = {r["doc_id"]: (r["license_id"], r["origin"]) for r in licenses.scan(clashing(spark.createDataFrame(files, "doc_id long, path string, text string"))).collect()}
    assert got == {1: ("MIT", "file"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "file"), 4: ("GPL-3.0", "header"), 5: (None, "none"), 6: (None, "none"), 7: ("MIT", "inherited")}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_full_texts_tags_and_versions(spark):
    from gridloom.llm import license_texts as L

    year = "Copyright (c) 2021 Some Body\n\n"
    files = {
        "MIT": year + L._MIT, "ISC": year + L._ISC + "\n\n" + L._ISC_TAIL, "BSD-2-Clause": year + L._BSD_HEAD.replace(". 2.", ".\n2.") + "\n\n" + L._BSD_TAIL, "BSD-3-Clause": year + L._BSD_HEAD + "\n\n" + L._BSD_NAMES + "\n\n" + L._BSD_TAIL,
        "Apache-2.0": year + L._APACHE, "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nmore", "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nmore",
        "GPL-3.0": L._GNU.format(name="General Public License", version="3"), "GPL-2.0": "licensed under the GPL v2", "Zlib": L._ZLIB, "Unlicense": L._UNLICENSE, "BSL-1.0": L._BOOST, "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    }
    tags = {"MPL-2.0": "// SPDX-License-Identifier: MPL-2.0", "GPL-2.0": "# SPDX-License-Identifier: GPL-2.0-only", "LGPL-2.1": "/* SPDX-License-Identifier: LGPL-2.1-or-later */", "MIT": "SPDX-License-Identifier: (MIT OR Apache-2.0)", "AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0+"}
    rows = [(k, f"p{k}/LICENSE", text, want) for k, (want, text) in enumerate(files.items())] + [(100 + k, f"q{k}/a.c", "int x;\n" + text + "\nint y;", want) for k, (want, text) in enumerate(tags.items())]
    rows += [(300, "r/LICENSE", "All rights reserved, no licence to anybody whatsoever, ask our lawyers", None), (301, "r/x", "the copyright of 1999 and of 2.0 things", None)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")).collect()}
    assert got == {k: want for k, _, _, want in rows}


def test_licences_of_awkward_files(spark):
    mit = "Released under the MIT License."
    rows = [(1, "a/LICENSE", mit), (1, "a/LICENSE", mit), (1, "a/LICENSE", None), (2, "a/b/c/d/e/f.txt", None), (None, "a/x", mit), (3, "LICENSE", "Released under the ISC License."), (4, "top.txt", "x" * 200_000), (5, "z/COPYING", "text\n" * 5000 + mit)]
    rows += [(6, "t/LICENSE", "Released under the MIT License.\nReleased under the ISC License."), (7, "t/u", "")]
    made = licenses.scan(clashing(spark.createDataFrame(rows, "doc_id long, path string, text string"))).collect()
    got = sorted((str(r["doc_id"]), r["license_id"], r["origin"]) for r in made)
    assert got == sorted([("1", "MIT", "file")] * 3 + [("2", "MIT", "inherited"), ("None", "MIT", "inherited"), ("3", "ISC", "file"), ("4", "ISC", "inherited"), ("5", "MIT", "file"), ("6", "ISC", "file"), ("7", "ISC", "inherited")])


# 8. languages


def test_languages_are_found_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    r = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["n"] > 150 and r["a"] > 0.95 and 0 <= r["lo"] <= r["hi"] <= 1


def test_mixtures_and_undetermined_texts(spark):
    rng = random.Random(12)
    train = [(k, " ".join(rng.choice(v) for _ in range(60)), lang, "s", None) for k, (lang, v) in enumerate([("aa", ["the", "thing", "with"]), ("bb", ["und", "schön", "nicht"])] * 20)]
    model = langid.fit(spark.createDataFrame(train, DOCS), rows=10)
    assert model.languages == ["aa", "bb"]
    half = "the thing with " * 20 + "und schön nicht " * 20
    texts = ["the with", "nicht und", half, None, "", "12 .. 3", "zzz", *AWKWARD]
    got = {r["doc_id"]: r for r in langid.identify(clashing(docs_of(spark, texts)), model).collect()}
    assert got[0]["lang_pred"] == "aa" and got[1]["lang_pred"] == "bb" and got[2]["languages"] == ["aa", "bb"] and 0.4 < got[2]["score"] < 0.6
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (3, 4, 5)) and got[6]["lang_pred"] in ("aa", "bb")
    assert len(got) == len(texts)
    empty = langid.fit(spark.createDataFrame([], DOCS))
    assert langid.identify(docs_of(spark, ["word"]), empty).first()["lang_pred"] == "und"
    assert [langid.is_held_out(k) for k in range(50)] == [r[0] for r in spark.range(50).select(langid.held_out("id")).collect()]


def test_mixtures_equal_direct_maximisation():
    rng = np.random.default_rng(5)
    grid = [(a, b, 60 - a - b) for a in range(61) for b in range(61 - a)]
    found_sizes = set()
    for trial in range(40):
        p = rng.dirichlet(np.full(30, 0.3), 3).T + 1e-3
        p /= p.sum(axis=0)
        share = [(1, 0, 0), (0.5, 0.5, 0), (0.4, 0.3, 0.3), (0.9, 0.1, 0)][trial % 4]
        n = rng.multinomial(rng.integers(20, 400), p @ np.array(share)).astype(float)
        at = np.flatnonzero(n)
        model = langid.Model(["a", "b", "c"], p, np.full(3, 1 / 3))
        got, chosen = model.mixture(at, n[at])
        q, m = p[at], n[at]
        keep = q.max(axis=1) > 1.001 * q.min(axis=1)
        q, m = q[keep], m[keep]
        cost = 0.5 * np.log(m.sum())
        fits = {w: m @ np.log(q @ (np.array(w) / 60)) - cost * (sum(x > 0 for x in w) - 1) for w in grid}
        best = max(fits, key=fits.get)
        own = m @ np.log(q @ got) - cost * (len(chosen) - 1)
        assert own >= fits[best] - 0.1
        if fits[best] > max(v for w, v in fits.items() if [x > 0 for x in w] != [x > 0 for x in best]) + 0.2:
            assert sorted(chosen.tolist()) == [k for k, x in enumerate(best) if x] and np.abs(got - np.array(best) / 60).max() < 0.06
        found_sizes.add(len(chosen))
    assert found_sizes == {1, 2, 3}


def test_learning_takes_a_bounded_number_of_texts_and_any_number_of_languages(spark, monkeypatch):
    many = spark.range(3000).selectExpr("cast(null as long) as doc_id", "if(id % 3 = 0, 'aaa', concat('w', id)) as text", "if(id % 2 = 0, 'x', 'y') as lang")
    model = langid.fit(many, rows=50)
    assert model.languages == ["x", "y"] and len(model.prior) == 2 and len(model.likelihood) == langid.CELLS
    assert langid.identify(many.limit(0), model).count() == 0 and sum(r["lang_pred"] == "und" for r in langid.identify(many.withColumn("text", F.lit("12")), model).collect()) == 3000
    assert [langid.cells_for(n) for n in (0, 1, 128, 129, 256, 32_768)] == [1 << 16, 1 << 16, 1 << 16, 1 << 15, 1 << 15, 1 << 8]
    with pytest.raises(ValueError):
        langid.cells_for(32_769)
    # 300 languages with a word of their own: more than the 128 of whole columns, and none is lost.
    word = lambda k: f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k % 7)}"
    rows = [(k, " ".join([word(k % 300)] * 30), f"l{k % 300:03}") for k in range(900)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=5)
    assert len(model.languages) == 300 and len(model.likelihood) == 1 << 14
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[k] == lang for k, _, lang in rows) > 850


def test_the_language_decides_what_stays_and_none_is_missed_without_labels(spark):
    rows = [(k, " ".join([("the thing with that", "und schön nicht auch")[k % 2]] * 20), ("aa", "bb")[k % 2]) for k in range(40)]
    docs = spark.createDataFrame([*rows, (50, "12 34", "aa"), (51, None, "aa"), (52, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(langid.in_a_language(docs, model)) == list(range(40))
    assert ids(langid.in_a_language(docs, model, wanted=frozenset(["bb"]))) == list(range(1, 40, 2))
    mixed = spark.createDataFrame([(0, "the thing with that " * 20 + "und schön nicht auch " * 20, None)], "doc_id long, text string, lang string")
    assert ids(langid.in_a_language(mixed, model, least=0.3)) == [0] and ids(langid.in_a_language(mixed, model, least=0.9)) == []
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert ids(langid.in_a_language(bare, langid.learnt(bare))) == list(range(40))


# 10. WARC


def test_warc_files_round_trip_and_derivatives_link(spark, tmp_path):
    pages = clashing(spark.createDataFrame([(1, "http://h/1", "<html lang='EN'><title>T &amp; u</title><body><p>One<p>two <a href=x>l</a></body></html>"), (2, None, None), (3, "http://h/3", "é\r\n\r\nWARC/1.1 in a text")], "page_id long, url string, html string"))
    source = warc.responses(pages)
    made = warc.derivatives(source).cache()
    rows = {(r["page_id"], r["warc_type"]): r for r in warc.derivative_rows(made).collect()}
    assert len(rows) == 6 and rows[1, "conversion"]["content"] == "One\ntwo l"
    assert "title: T & u\r\nlanguage: en\r\noutlinks: 1" in rows[1, "metadata"]["content"]
    ids = {r["page_id"]: r for r in source.collect()}
    for (k, _), r in rows.items():
        assert r["refers_to"] == ids[k]["record_id"] and r["source_payload_digest"] == dict(ids[k]["headers"])["WARC-Payload-Digest"]
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["content"].encode()).hexdigest()
    every = source.drop("page_id").unionByName(made.drop("page_id"))
    warc.write_warc(every, str(tmp_path / "w"))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w") + "/*.txt").collect()}
    for r in every.collect():
        b = back[r["record_id"]]
        assert bytes(b["block"]) == bytes(r["block"]) and b["warc_type"] == r["warc_type"] and b["refers_to"] == r["refers_to"] and [tuple(h) for h in b["headers"]] == [tuple(h) for h in r["headers"] if h["value"]]
    assert warc.derivatives(source.limit(0)).count() == 0


def test_warc_keeps_repeated_headers_undoes_codings_and_reads_cut_and_compressed_files(spark, tmp_path):
    import gzip

    import zstandard

    page = b"<html><body><p>One</p><p>two</p></body></html>"
    packed = gzip.compress(page)
    chunked = b"".join(b"%x;x=y\r\n" % len(c) + c + b"\r\n" for c in (packed[:10], packed[10:])) + b"0\r\n\r\n"
    codings = {
        "plain": (b"", page), "gzip": (b"Content-Encoding: gzip\r\n", packed), "both": (b"content-encoding: GZIP\r\nTransfer-Encoding: chunked\r\n", chunked),
        "deflate": (b"Content-Encoding: deflate\r\n", zlib.compress(page)), "zstd": (b"Content-Encoding: zstd\r\n", zstandard.compress(page)), "untrue": (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", page),
    }
    body = lambda more, payload: b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html\r\nSet-Cookie: b=2\r\n" + more + b"\r\n" + payload
    record = lambda name, block: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: " + name.encode() + b"\r\nWARC-Note: x\r\nWARC-Note: y\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    records = [record(n, body(*c)) for n, c in codings.items()]
    (tmp_path / "a.warc").write_bytes(b"".join(records) + record("cut", body(b"", page))[:-30])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\n")
    rows = warc.read_warc(spark, str(tmp_path)).cache()
    assert rows.count() == 13
    for r in rows.collect():
        notes = [tuple(h) for h in r["headers"]]
        assert notes == [("WARC-Note", "x"), ("WARC-Note", "y"), *([("WARC-Truncated", "length")] if r["record_id"] == "cut" else [])]
    for r in warc.derivative_rows(warc.derivatives(rows)).collect():
        if r["warc_type"] == "metadata":
            assert "http-set-cookie: a=1\r\nhttp-set-cookie: b=2\r\n" in r["content"] and r["source_content_type"] == "text/html"
        else:
            assert r["content"].startswith("One\ntwo") or r["refers_to"] == "cut"
