"""BPE, token files, shards, vectors and pages against brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from encodelens.llm import bpe, hilbert, htmltext, queries, tokenfiles, vectors

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")


def texts(n, seed=2):
    rng = random.Random(seed)
    parts = ["the", " cat", " sat", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "123", " 45", "!?", " …", " ", " ", "ABC", "a" * 30, "\x1c", "\x85", "²", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.mark.parametrize("chunk, overlap", [(16384, 1024), (40, 20), (9, 4)])
def test_bpe_is_the_librarys(spark, chunk, overlap):
    rows = [(i, t, i) for i, t in enumerate([*texts(40), "", None, "x" * 300, " " * 200, "ab " * 100])]
    rows += rows[-3:] + [(None, "a b c" * 40, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    e = bpe.encoding(RANKS, PATTERN)
    want = sorted((str(i), np.array(e.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, _ in rows)
    got = bpe.tokenize(df, RANKS, PATTERN, chunk=chunk, overlap=overlap)
    assert sorted((str(r.id), bytes(r.ids)) for r in got.collect()) == want
    back = bpe.with_decoded(got, RANKS, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.tokenize(df.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_long_texts(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["the ", "日本", "é", "\n\n", "12345", "don't ", "  "]) for _ in range(n)), 1) for i, n in enumerate((30_000, 90_000, 400_000, 9_000))]
    rows += [rows[0], (None, rows[1][1], 2), (7, "x" * 70_000, 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, key int")
    e = bpe.encoding(RANKS, PATTERN)
    want = sorted((str(i), np.array(e.encode_ordinary(t), "<u4").tobytes()) for i, t, _ in rows)
    assert sorted((str(r.id), bytes(r.ids)) for r in bpe.tokenize(df, RANKS, PATTERN).collect()) == want


def test_bpe_query(spark, data):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_byte_bpe(spark, data).collect()}
    e = bpe.encoding(RANKS, PATTERN)
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = e.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert not got


def test_elias_fano():
    rng = np.random.default_rng(4)
    for values in ([], [0], [5], [0, 0, 0], [7] * 300, np.cumsum(rng.integers(0, 4000, 1000)), np.cumsum(rng.integers(0, 2, 50_000)), [3, 10**9], [0, 1, 2**64 - 1]):
        v = np.array(values, np.uint64)
        raw = b"zz" + tokenfiles.EliasFano.of(v).to_bytes()
        ef, end = tokenfiles.EliasFano.from_bytes(raw, 2)
        assert end == len(raw) and [x for _, run in ef.runs() for x in run.tolist()] == v.tolist()
        assert all(ef.select(i).tolist() == [v[i]] for i in range(0, len(v), 1 + len(v) // 900))
        for i in {0, 63, 64, 65, len(v) // 2} & set(range(len(v))):
            assert ef.select(i, len(v)).tolist() == v[i:].tolist()
    spread = np.cumsum(rng.integers(0, 2000, 20_000))
    assert len(tokenfiles.EliasFano.of(spread).to_bytes()) < 2.1 * len(spread)


def test_segment():
    docs, ids = [np.arange(n) for n in (3, 0, 5, 1)], [None, -(2**63), 4, 2**63 - 1]
    s = tokenfiles.Segment(tokenfiles.pack(docs, ids, 4))
    assert s.doc_ids(0, 4) == ids and s.doc_ids(2, 3) == [4] and s.offsets(0, 4).tolist() == [0, 3, 3, 8, 9]
    assert [s.document(i).tolist() for i in range(4)] == [d.tolist() for d in docs]
    assert tokenfiles.Segment(tokenfiles.pack([], [], 2)).n_docs == 0


@pytest.mark.parametrize("room", [400_000, 5, 0])
def test_tokens_are_the_librarys(room):
    t, lib = tokenfiles.Tokens(JSON, room), Tokenizer.from_file(JSON)
    some = [*texts(300, 8), "", None, " lead", "trail ", "a  b", "one two three", "x" * 500 + " " + "y", "\nl", "a\n\n b c", "a \nb", "don't. stop!?", "\u00a0 x"]
    want = [np.array(lib.encode(x or "", add_special_tokens=False).ids, "<u2").tobytes() for x in some]
    for _ in range(2):
        assert t.encode(pa.array(some)).to_pylist() == want
        assert t.encode(pa.array(some[::-1])).to_pylist() == want[::-1]


def test_token_files(spark, data):
    lib, at = Tokenizer.from_file(JSON), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_files(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got.pop(r.doc_id) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


@pytest.mark.parametrize("broadcast", [64 << 20, -1])
def test_token_files_odd_rows(spark, tmp_path, broadcast):
    rows = [(3, None, 1), (3, "b", 1), (1, "", 1), (2, "word " * 3000, 1), (None, "c", 1), (None, None, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    tokenfiles.write_tokens(df, f"{tmp_path}/t", JSON, segment_ids=100)
    got = tokenfiles.read_tokens(spark, f"{tmp_path}/t", broadcast).orderBy("start").collect()
    assert [r.id for r in got] == [None] * 3 + [1, 2, 3, 3] and sorted(len(r.ids) // 4 for r in got) == [1, 1, 1, 1, 2, 2, 3002]
    assert [r.start for r in got] == [sum(len(x.ids) // 4 for x in got[:i]) for i in range(len(got))]
    tokenfiles.write_tokens(df.limit(0), f"{tmp_path}/e", JSON)
    assert tokenfiles.read_tokens(spark, f"{tmp_path}/e", broadcast).count() == 0


def curve_walk(bits, dims, spark):
    n = 1 << bits * dims
    cells = [tuple(c >> bits * d & (1 << bits) - 1 for d in range(dims)) for c in range(n)]
    df = spark.createDataFrame(cells, ", ".join(f"l{d} int" for d in range(dims)))
    return [tuple(r[:dims]) for r in hilbert.with_hilbert(df, [f"l{d}" for d in range(dims)], bits=bits).orderBy("curve").collect()], n


@pytest.mark.parametrize("bits, dims", [(3, 2), (2, 3), (2, 4)])
def test_curve_visits_neighbours(spark, bits, dims):
    walk, n = curve_walk(bits, dims, spark)
    assert len(set(walk)) == n
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(walk, walk[1:]))


def test_shards(spark, data):
    got = queries.op3_hilbert_shards(spark, data).collect()
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows.items()}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_odd_rows(spark, tmp_path):
    rows = [(1, None, None, "en", 0), (1, None, None, "en", 0), (-5, "", "s", None, 1), (None, "é" * 9, "t", "fr", 2), (2**62, "x" * 300_000, "", "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, slot int")
    got = hilbert.shard(df)
    assert got.count() == 5 and hilbert.shard(df.limit(0)).count() == 0
    hilbert.write_shards(df.drop("slot"), hilbert.shard(df, shards=2), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 5 and sorted(str(r.text) for r in back.collect()) == sorted(str(r[1]) for r in rows)
    assert {(r.shard, r.slot) for r in back.collect()} == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)}


def test_shards_prune(spark):
    """Files hold fewer sources, languages and sizes than files in id order, so that min and max leave more of them out."""
    rng = random.Random(8)
    rows = [(i * 256, "x" * int(2 ** rng.uniform(3, 13)), f"src{rng.randrange(20)}", rng.choice(["de", "en", "es", "fr"])) for i in range(3000)]
    got = hilbert.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    by_id = {r[0]: r for r in rows}

    def read(shard_of):
        """Shards that a filter on one source, one language or one size has to read, on average."""
        spans = {}
        for i, s in shard_of.items():
            for d, v in enumerate((by_id[i][2], by_id[i][3], len(by_id[i][1]))):
                lo, hi = spans.get((s, d), (v, v))
                spans[s, d] = min(lo, v), max(hi, v)
        asked = [(0, f"src{k}") for k in range(20)] + [(1, x) for x in ("de", "en", "es", "fr")] + [(2, 2**k) for k in range(3, 13)]
        return sum(lo <= v <= hi for d, v in asked for (s, e), (lo, hi) in spans.items() if e == d) / len(asked)

    curve, ids = read({r.doc_id: r.shard for r in got}), read({r[0]: n * 24 // 3000 for n, r in enumerate(rows)})
    assert curve < 0.7 * ids


def brute_vectors(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v]
    good = [(i, v / np.linalg.norm(v)) for i, v in good if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    m = np.stack([v for _, v in good])
    near = m @ m.T >= least
    np.fill_diagonal(near, False)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        x, y = root(good[a][0]), root(good[b][0])
        up[max(x, y)] = min(x, y)
    n = {i: 0 for i, _ in rows} | {i: int(near[k].sum()) for k, (i, _) in enumerate(good)}
    return {i: (n[i], root(i)) for i, _ in rows}


@pytest.mark.parametrize("block, cell", [(2048, 10_000), (16, 10_000), (16, 40)])
def test_vectors(spark, block, cell):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 24))
    rows = [(i, (centre[rng.integers(40) if i % 3 else 0] + rng.normal(size=24) * rng.choice([0.02, 0.2, 0.3])).tolist()) for i in range(500)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [float("inf")] + [0.0] * 23)]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, block=block, rows_a_cell=cell).collect()}
    want = brute_vectors(rows)
    if cell > 500:
        assert got == want
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found <= there and found >= 0.98 * there
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_exact(spark):
    """With as many probes as cells every pair is found, however small the cells are."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.25])).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, rows_a_cell=8, block=32, probes=4096).collect()}
    assert got == brute_vectors(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_of_many_copies(spark, kind):
    """Equal vectors, -0 and 0 alike, are compared once and count in full, their own and their neighbours' links too."""
    rng = np.random.default_rng(9)
    hot, other = [1.0, 0.0, 0.5, 0.25], [1.0, -0.0, 0.5, 0.3125]
    rows = [(i, hot if i % 3 == 0 else other if i % 3 == 1 else rng.integers(-4, 5, 4).astype(float).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0, -0.0, 0.5, 0.25]) for i in range(20)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, block=16, rows_a_cell=10_000).collect()}
    assert got == brute_vectors(rows) and got[0][0] > 400


def test_nearest():
    rng = np.random.default_rng(4)
    rows, centres = rng.normal(size=(101, 5)), vectors.unit(rng.normal(size=(37, 5)))[0]
    want = np.argsort(-(vectors.unit(rows)[0] @ centres.T), axis=1, kind="stable")
    for probes in (1, 6, 37, 99):
        assert (vectors.nearest(rows, centres, probes, cells_at_once=100) == want[:, :probes]).all()


def test_vectors_repeats(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, [0.0, 2.0]), (3, None), (5, [1.0, 0.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: str(r)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=key) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (None, 0, None, True), (4, 1, 3, False), (3, 0, 3, True), (5, 0, 5, True)], key=key)


@pytest.mark.parametrize("sf, rows_a_cell", [("sf0.001", 256), ("sf0.01", 256), ("sf0.01", 16)])
def test_vectors_query(spark, data, sf, rows_a_cell):
    """Recall of links against brute force over all pairs, and no link that is none."""
    folder = data.replace("sf0.001", sf)
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = brute_vectors([(r.vec_id, r.embedding) for r in df.collect()])
    out = queries.op7_embedding_near_dedup(spark, folder) if rows_a_cell == 256 else vectors.near_duplicates(df, rows_a_cell=rows_a_cell)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert set(got) == set(want) and all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


PAGE = """<html><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="sidebar"><p>More</p></div><article class="post-7"><header><h1>The &amp; title</h1></header><p>First <b>bold
 text.<br>here<p>Second&nbsp;&lt;p&gt;<script>var a="</p>";</script></p><form><p>Search</p></form>
<ul><li>one<li>two</ul></article><div id="comments"><p>Nice post!</p></div><footer>&copy; x</footer></body></html>"""


def test_page():
    want = "The & title\n\nFirst bold text. here\n\nSecond <p>\n\none\n\ntwo"
    assert htmltext.extract(PAGE, "body/article.post-#") == want
    assert htmltext.extract(PAGE, None) == want and htmltext.extract(PAGE, "body/div.other") == want
    named = '<body><div class="page-header-layout"><article><p>Here it is.</p></article><p>Not this</p></div></body>'
    assert htmltext.extract(named, None) == "Here it is." and htmltext.extract('<div class="comments"><p>Hi</p></div>', None) == ""
    assert htmltext.extract(None, None) == "" and htmltext.extract("", "x") == "" and htmltext.extract("<nav>a</nav>", None) == ""


def test_page_nested_and_mixed_layouts():
    long = "Long running text of the page. " * 9
    page = f"<body><article><h1>Title</h1><p>Lead.</p><div class=entry-content><p>{long}</p></div><section><p>End.</p></section></article><p>Tail</p></body>"
    want = f"Title\n\nLead.\n\n{long.strip()}\n\nEnd."
    assert htmltext.extract(page, "body/article") == htmltext.extract(page, None) == want
    mixed = f"<body><div class=main><p>Stub.</p></div><div class=story><p>{long}</p></div></body>"
    assert htmltext.extract(mixed, "body/div.main") == f"Stub.\n\n{long.strip()}"


def test_page_wrappers_with_side_names():
    long = "Long running text of the page. " * 9
    layout = f"<div class='layout with-sidebar'><article><p>{long}</p><div id=comments><article><p>Nice!</p></article></div></article></div><p>tagline</p>"
    assert htmltext.extract(layout, None) == long.strip()
    plain = f"<div class='page no-sidebar'><div class='has-header'><div class=post><p>{long}</p></div></div><div class=sidebar><div><p>More</p></div></div></div>"
    assert htmltext.extract(plain, None) == long.strip()
    assert htmltext.extract(f"<div class=post><p>{long}</p></div><div class=comments><div><p>Nice!</p></div></div>", None) == long.strip()


def test_page_names_within_articles():
    long = "Long running text of the page. " * 9
    page = f"<article><div class=article-header><h1>Title</h1></div><p class=notice-text>{long}</p><blockquote class=tags>Quoted.</blockquote><p class=ad>Buy!</p><div class=ad><p>Buy!</p></div><div class=notice><p>Cookies.</p></div></article>"
    assert htmltext.extract(page, None) == f"Title\n\n{long.strip()}\n\nQuoted."


def test_page_bad_markup():
    for page, want in {
        'a <b title="x>y" c>bold</b> d': "a bold d", "a<p class='x>b": "a\n\nb", "1 < 2 <3 <p>x": "1 < 2 <3\n\nx", '<p title=">">in</p>out': "in\n\nout", "<!-- <p>no</p>": "",
        "<p>one</span>two</p><![CDATA[x]]>three<!doctype html>": "onetwo\n\nthree", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\n\nb\n\nc\n\nd", "<p a='>x": "x",
    }.items():
        assert "\n\n".join(t for _, t, _ in htmltext.blocks(page)) == want, page


@pytest.mark.parametrize("page", ['<a "' * 40_000, "<a =\"" * 40_001 + ">", "<div>" * 30_000 + "x", "<div class=comments>" * 9_000 + "<p>x" * 5_000, "<span>" * 20_000 + "<hr>" * 30_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000, "<li><b>" * 30_000, "<p><td><i>" + "<b>" * 20_000 + "<hr>" * 20_000, "<title>" * 30_000, "<!--" * 40_000])
def test_page_takes_linear_time(page):
    import time

    began = time.process_time()
    htmltext.extract(page, "body/article")
    assert time.process_time() - began < 3


def test_pages_without_articles(spark):
    """Two templates of one host, neither with an article element, and comments beside the text."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9))) for _ in range(n)).capitalize() + "."
    menu = "<ul class=nav>" + "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(20)) + "</ul>"
    rows, want = [], {}
    for i in range(30):
        body = [prose(rng.randrange(30, 80)) for _ in range(rng.randrange(2, 5))]
        ps = "".join(f"<p>{p}</p>" for p in body)
        if i % 3:
            html = f"<html><body>{menu}<div class='post post-{i}'><h2>Head {i}</h2><div class=text>{ps}</div></div><div class=comments><p>{prose(90)}</p></div><div class=right><p><a href=/x>{prose(5)}</a></p></div></body></html>"
            want[i] = (body, f"Head {i}")
        else:
            html = f"<table><tr><td>{menu}</td><td class=story>{ps}</td></tr></table><div id=footer>{prose(9)}</div>"
            want[i] = (body, None)
        rows.append((i, f"http://two.example/{i}", html))
    got = {r.id: r.text.split("\n\n") for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (body, _) in want.items():
        assert [p for p in got[i] if not p.startswith("Head")] == body


def test_pages_against_articles(spark, data):
    import html

    got = {r.page_id: r.text for r in queries.op10_html_main_text(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_pages_vote(spark):
    odd = "<body><div class=main><p>" + "Long running text of the page. " * 9 + "</p></div><div class=extra><p>" + "Something else that is long. " * 2 + "</p></div></body>"
    rows = [(i, "http://h.example/a", odd, "x") for i in range(5)] + [(7, None, None, "x"), (8, "http://h.example/b", "", "x"), (9, "http://h.example/c", "<p>Only this", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    for limit in (64 << 20, -1):
        got = {r.id: r for r in htmltext.main_text(df, broadcast_bytes=limit).collect()}
        assert got[1].path == "body/div.main" and "Something" not in got[1].text and got[9].text == "Only this" and got[7].text == got[8].text == ""
    assert htmltext.main_text(df.limit(0)).count() == 0
