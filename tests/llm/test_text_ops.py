"""Operators on texts against brute force: quality, SimHash, line dedup, mixing, language, pipeline."""

import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from encodelens.llm import common, langid, linededup, mixing, neartexts, quality, queries, simhash
from encodelens.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size string, rate int"


def docs(spark, rows):
    """Rows (doc_id, text, source) with extra columns of names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 3) for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, "ÄÖ é " * 30, None), (6, "w " * 50_000, "a"), (None, "no id here", "b")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, duck, same, name):
    same(queries.QUERIES[name](spark, data), duck, queries.ORACLES[name])


def repeat_words(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)})


def test_quality_figures():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é"]) for _ in range(rng.randrange(160)))
        t, w = quality.Text(text), WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (t.n_words, t.word_chars, t.n_symbols) == (len(w), sum(map(len, w)), text.count("#"))
        assert t.n_dup_lines == len(lines) - len(set(lines))
        assert t.n_repeat_words == repeat_words(text)


def test_quality_order_moves_no_verdict(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    names = [r.name for r in quality.RULES]
    a = {r.doc_id: r.kept for r in quality.judge(d, order=names).collect()}
    b = {r.doc_id: r.kept for r in quality.judge(d, order=names[::-1], figures=False).collect()}
    assert a == b
    assert {r.doc_id for r in quality.accepted(d).collect()} == {i for i, k in a.items() if k}
    assert quality.cascade_order([("slow", 1.0, 0.5), ("fast", 0.1, 0.2), ("none", 0.01, 0.0)]) == ["fast", "slow", "none"]


def test_quality_order_on_a_sample(spark):
    """A rule is charged what it adds after the base, on rows that pass it, and counts the rows that others leave."""
    order = quality.greedy_order([("a", 1.0, 0.6), ("b", 1.0, 0.5), ("c", 1.0, 0.3), ("d", 0.1, 0.0)], {frozenset("ab"): 5, frozenset("a"): 1, frozenset("c"): 3, frozenset(): 1})
    assert order == ["a", "c", "b", "d"]
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 2 else "too few", "s") for i in range(60)] + [(100 + i, good.replace(" ", "# "), "s") for i in range(20)]
    alone, together = quality.measure(docs(spark, rows), parts=99)
    share = {name: x for name, _, x in alone}
    assert share["symbols"] == pytest.approx(20 / 50) and sum(together.values()) == 50 and all(c > 0 for _, c, _ in alone)
    assert quality.measure(docs(spark, []))[1] == {} and quality.greedy_order(*quality.measure(docs(spark, []))) == sorted(share)


def test_quality_odd_rows(spark):
    got = quality.judge(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.base_failed for r in got if r.doc_id in (1, 2, 3, 4, 6, None))
    assert quality.judge(docs(spark, [])).count() == 0
    assert quality.accepted(docs(spark, [])).columns == docs(spark, []).columns


def slow_fingerprint(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_against_all_pairs(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = classes(fp, pairs)
    got = queries.op2_simhash_near_dedup(spark, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


@pytest.mark.parametrize("hot", [256, 3, 0])
def test_simhash_links(spark, hot):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = list({b ^ sum(1 << p for p in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 2, 3, 3, 4)} | {base[0] ^ 1 << i for i in range(64)} | {base[1] ^ 1 << i ^ 1 << j for i in range(20) for j in range(i)})
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot=hot).collect()]
    assert all((signed[a] ^ signed[b]).bit_count() <= 3 for a, b in got) and len(set(map(frozenset, got))) == len(got) or hot < 256
    pairs = [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 3]
    if hot == 256:
        assert len(got) == len(pairs)
    assert classes(signed, got) == classes(signed, pairs)


def test_simhash_keep_one(spark):
    t, u, v = "one two three four five six", "seven eight nine ten", "eleven twelve"
    rows = [(4, t, "a"), (4, t, "a"), (None, t, "b"), (None, u, "b"), (None, u, "c"), (4, v, "a"), (9, v, "a"), (3, u + " " + t, "x")]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(4, t), (None, u), (4, v), (3, u + " " + t)], key=str)
    rows = [(5, "x", ""), (6, "x", ""), (None, "x", "")]
    assert {r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()} == {5}


def five(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def alike(rows):
    """Pairs of rows (id, text) of a five-word Jaccard similarity of 0.8 or more."""
    sets, having = {i: five(t) for i, t in rows}, {}
    for i, s in sets.items():
        for g in s:
            having.setdefault(g, []).append(i)
    pairs = {(min(a, b), max(a, b)) for ids in having.values() for n, a in enumerate(ids) for b in ids[:n]}
    return [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_near_texts(spark):
    """Copies with words changed, dropped or added: what is joined is right, and few pairs are missed."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 45))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [word()], [w[at], word()], [w[at].upper()]))
            rows.append((n, " ".join(w), "s"))
            n += 1
    pairs = alike([r[:2] for r in rows])
    want = classes([r[0] for r in rows], pairs)
    roots = {}
    for r in neartexts.grouped(docs(spark, rows)).collect():
        roots.setdefault(r.root, []).append(r.id)
    got = {i: min(ids) for ids in roots.values() for i in ids}
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs) and len(pairs) > 60


def test_near_texts_large_group(spark):
    """A group of copies that each differ from one text by a word: all are joined up, with few candidates."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base if i == 700 else [*base[: i % 190], f"x{i}", *base[i % 190 + 1 :]]), "s") for i in range(1000)]
    kept = neartexts.keep_one(docs(spark, rows)).collect()
    assert [r.doc_id for r in kept] == [0]


@pytest.mark.parametrize("block", [2048, 5])
def test_near_texts_spread_group(spark, monkeypatch, block):
    """Copies of one text that are mostly too far from each other to be linked, some by way of the text itself."""
    monkeypatch.setattr(neartexts, "LIST", block)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 160):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            w[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w), "s"))
    pairs = alike([r[:2] for r in rows])
    roots = {}
    for r in neartexts.grouped(docs(spark, rows)).collect():
        roots.setdefault(r.root, []).append(r.id)
    got, want = {i: min(ids) for ids in roots.values() for i in ids}, classes([r[0] for r in rows], pairs)
    assert all(want[i] == want[c] for i, c in got.items()) and sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert 1 < len(set(want.values())) < 160


def test_sketches_estimate():
    """Whole sets give the similarity itself, less nothing; cut ones come near it."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n, shared in ((1, 1), (5, 3), (100, 90), (200, 0), (5000, 4500), (5000, 0), (255, 250), (300, 290)):
        h = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = h[:n], h[n - shared : 2 * n - shared]
        x, y = (np.frombuffer(neartexts.sketch(v), "<u4") for v in (a, b))
        rows = [np.pad(v, (0, neartexts.MINIMA - len(v)), constant_values=2**32 - 1)[None, :] for v in (x, y)]
        got = neartexts.estimate(*rows, np.array([len(x)]), np.array([len(y)]))[0]
        true = shared / (2 * n - shared)
        assert true <= got <= true + (0.2 if n >= neartexts.MINIMA else 0.002)


def test_near_texts_odd_rows(spark):
    out = neartexts.keep_one(docs(spark, ODD))
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "4", "5", "6", "None"] and out.columns == docs(spark, []).columns
    assert neartexts.keep_one(docs(spark, [])).count() == 0


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6}


@pytest.mark.parametrize("edges_a_task", [1 << 19, 40, 7])
def test_components(spark, monkeypatch, edges_a_task):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(100, 340)]
    ball = [(a, b) for a in range(1000, 1030) for b in range(a)[:] if b >= 1000]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + rng.sample(chain, len(chain)) + ball + [(None, 5), (7, None)]
    rounds = []
    monkeypatch.setattr(common, "written", lambda df, label, f=common.written: rounds.append(label) or f(df, label))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), edges_a_task=edges_a_task).collect()}
    edges = [e for e in edges if None not in e]
    want = classes({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert rounds.count("edges") <= 9
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_paths_agree(spark):
    rows = [(i, f"menu\nown {i}\n\nmenu\nfoot", "s") for i in range(40)] + [(90, None, "s"), (91, "menu", None), (92, "foot\nfoot", "t"), (92, "foot\nfoot", "t")]
    d = docs(spark, rows).withColumnsRenamed({"lang": "row", "size": "host", "rate": "cut"}).withColumn("_h", F.lit(1)).withColumn("page", F.lit("p"))
    a = linededup.drop_boilerplate(d)
    b = linededup.drop_boilerplate(d, broadcast_rows=-1)
    assert a.columns == b.columns == [*d.columns, "_lines", "_dropped"]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    by = {r.doc_id: r for r in a.collect()}
    assert by[3].text == "own 3\n" and by[3]._dropped == 3 and by[90].text is None
    assert by[91].text == "menu" and by[92].text == "foot\nfoot"
    assert linededup.drop_boilerplate(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        linededup.drop_boilerplate(d.withColumn("_lines", F.lit(1)))


@pytest.mark.parametrize("ratio", [0.05, 0.1])
@pytest.mark.parametrize("limit", [100_000, -1])
def test_line_dedup_against_loops(spark, ratio, limit):
    """Lines on 7 % and 12 % of the pages of one host; copies of a text are one page, few pages lose nothing."""
    rows = [(i, "\n".join([f"own {i}", *(["seven"] if i % 14 == 0 else []), *(["twelve"] * 2 if i % 8 == 0 else []), " "]), "s") for i in range(200)]
    rows += [(300 + i, "copied line\nand another", "s") for i in range(100)] + [(500 + i, f"menu\n{i}", "few") for i in range(4)] + [(600 + i, f"menu\n{i}", "five") for i in range(5)]
    pages = {(h, t) for _, t, h in rows}
    total = {h: sum(x == h for x, _ in pages) for h, _ in pages}
    on = {}
    for h, t in pages:
        for line in {x for x in t.split("\n") if x.strip()}:
            on[h, line] = on.get((h, line), 0) + 1
    bad = {k for k, n in on.items() if n >= 5 and n > ratio * total[k[0]]}
    got = {r.doc_id: (r.text, r._dropped) for r in linededup.drop_boilerplate(docs(spark, rows), ratio=ratio, broadcast_rows=limit).collect()}
    assert got == {i: ("\n".join(x for x in t.split("\n") if (h, x) not in bad), sum((h, x) in bad for x in t.split("\n"))) for i, t, h in rows}
    assert {x for _, x in bad} == ({"seven", "twelve", "menu"} if ratio < 0.1 else {"twelve", "menu"})


def test_stage_copies_keep_their_text(spark):
    import corpus_pipeline

    copied = {0: "alpha beta gamma\ndelta epsilon zeta", 1: "eins zwei drei\nvier fuenf sechs"}
    rows = [(i, copied.get(i % 3, f"own text of page {i}"), "s") for i in range(60)]
    out = corpus_pipeline.line_dedup(spark, docs(spark, rows), "")
    assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t, _ in rows}
    kept = {r.doc_id: r.text for r in corpus_pipeline.simhash_near_dedup(spark, out, "").collect()}
    assert kept[0] == copied[0] and kept[1] == copied[1]


def test_stage_cuts_lines_of_a_twentieth(spark):
    import corpus_pipeline

    rows = [(i, f"own text of page {i}" + ("\nread more here" if i < 7 else "\nseen again" if i < 12 else ""), "s") for i in range(100)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(spark, rows), "").collect()}
    assert got == {i: t.replace("\nread more here", "") for i, t, _ in rows}


def test_targets_share_by_weight(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), ("d", 300), ("e", 0), (None, 40)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {s: 1 + n % 3 for n, (s, _) in enumerate(sizes)}
    want, free, left = {}, dict(sizes), float(sum(n for _, n in sizes))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * free[s]]
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = 3.0 * free.pop(s)
            left -= want[s]
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(n for _, n in sizes))


def solved_rates(sizes, target):
    """The rates min(3, exp(tilt * size)) that give target, by halving."""
    lo, hi = -60.0, math.log(3)
    rate = lambda tilt, n: math.exp(min(tilt * n, math.log(3)))
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(n * rate(mid, n) for n in sizes) > target else (mid, hi)
    return {n: rate(lo, n) for n in sizes}


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * min(rng.randrange(1, 60), rng.randrange(1, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    rows += [(1000 + i, t, "d") for i, t in enumerate(["w " * 5000, "w " * 400, *["w"] * 50])]
    d = docs(spark, rows)
    out = mixing.mix(mixing.word_counts(d.select("doc_id", "source", "text"))).collect()
    for s in ("a", "b", "c", "d", None):
        some = [r for r in out if r.source == s]
        want = solved_rates([r.size for r in some], some[0].target)
        assert all(r.rate == pytest.approx(want[r.size], rel=1e-6) for r in some)
        assert len({round(r.rate, 6) for r in some}) > 1
        assert sum(r.rate * r.size for r in some) == pytest.approx(some[0].target)
        assert abs(sum(r.copies * r.size for r in some) - some[0].target) <= max(r.size for r in some) / 2
        assert all(0 <= r.copies <= 3 and abs(r.copies - r.rate) <= 1 for r in some)
    for buckets in (4, 1 << 16):
        again = mixing.mix(mixing.word_counts(d.select("doc_id", "source", "text")), buckets=buckets).collect()
        assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in out}
    clash = d.withColumnsRenamed({"rate": "_h", "size": "_size", "lang": "_copies"})
    again = mixing.mixed(clash)
    assert again.columns == clash.columns
    want = {r.doc_id: r.copies for r in out if r.copies}
    assert {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()} == want


def test_mix_odd_rows(spark):
    out = mixing.mix(mixing.word_counts(docs(spark, ODD).select("doc_id", "source", "text"))).collect()
    assert len(out) == len(ODD) and all(r.copies == 1 for r in out if not r.size) and all(r.target is not None for r in out)
    assert mixing.mixed(docs(spark, ODD)).count() == sum(r.copies for r in out)
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert mixing.mix(mixing.word_counts(docs(spark, [(1, "", "a"), (2, None, None)]).select("doc_id", "source", "text"))).count() == 2


def test_mix_without_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(50), rng.choice(["a", "b", None])) for i in range(200)]
    d = mixing.word_counts(docs(spark, rows).select("doc_id", "source", "text"))
    want = {r.doc_id: (r.copies, r.rate) for r in mixing.mix(d).collect()}
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda df, *_: (df, False))
    assert {r.doc_id: (r.copies, pytest.approx(r.rate)) for r in mixing.mix(d).collect()} == want


def test_language(spark, data):
    got = queries.op5_language_id(spark, data).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = [r for r in got if r.held_out]
    assert len(got) == len(true) and sum(r.lang_pred == true[r.doc_id] for r in out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_against_loops(spark, data):
    """Counts, log-odds, margins and decoding by plain loops over n-grams, text by text."""
    from collections import Counter

    rows = [r for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1

    def grams(text):
        raw = (" " + text.lower() + " ").encode()
        yield from (("2", raw[i] << 8 | raw[i + 1]) for i in range(len(raw) - 1))
        yield from (("3", (((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) % 2**32) >> 16) for i in range(len(raw) - 2))

    counts = {}
    for r in rows:
        if not held(r.doc_id) and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    langs = sorted(counts)
    sums = {x: {k: sum(n for (kind, _), n in c.items() if kind == k) for k in "23"} for x, c in counts.items()}
    share = lambda x, g: (counts[x][g] + 0.5) / (sums[x][g[0]] + 0.5 * 65536)
    code = langid.codewords(len(langs)).astype(int)
    got = {r.doc_id: r for r in queries.op5_language_id(spark, data).collect()}
    assert len(got) == len(rows)
    known = {}

    def odds(g):
        if g not in known:
            p = [share(x, g) for x in langs]
            known[g] = [math.log((sum(x for x, c in zip(p, col) if c > 0) / sum(col > 0)) / (sum(x for x, c in zip(p, col) if c < 0) / sum(col < 0))) for col in code.T]
        return known[g]

    for r in rows:
        assert got[r.doc_id].held_out == held(r.doc_id)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        n = Counter(grams(r.text))
        margin = [sum(k * odds(g)[j] for g, k in n.items()) / sum(n.values()) for j in range(code.shape[1])]
        size = [abs(m) / sum(map(abs, margin)) * len(margin) for m in margin]
        loss = [sum(s * math.log1p(math.exp(-8 * m * c)) for s, m, c in zip(size, margin, row)) for row in code]
        p = [math.exp(min(loss) - x) for x in loss]
        assert got[r.doc_id].lang_pred == langs[p.index(max(p))]
        assert got[r.doc_id].score == pytest.approx(max(p) / sum(p), abs=2e-4)


def test_language_repeats_and_clashes(spark):
    rows = [(1, "the cat and the dog", ""), (1, "the cat and the dog", ""), (2, "x" * 600_000, ""), (None, "the end", "")]
    d = docs(spark, rows).withColumnsRenamed({"size": "score", "rate": "ambiguous", "source": "lang_pred"})
    out = langid.predict(d, langid.train(d))
    assert out.columns == ["doc_id", "lang", "n_chars", "lang_pred", "score", "ambiguous"] and out.count() == 4
    assert {(r.lang_pred, r.score) for r in out.collect()} == {("en", 1.0)}


def test_language_odd_rows(spark):
    few = docs(spark, [(1, "the cat and the dog", ""), (2, "1 2 3 !", ""), (3, None, ""), (4, "", "")])
    model = langid.train(few)
    got = {r.doc_id: r for r in langid.predict(few.select("doc_id", "text"), model).collect()}
    assert got[1].lang_pred == "en" and [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert langid.predict(few.select("doc_id", "text"), langid.train(few.where("false"))).where("lang_pred <> 'und'").count() == 0
    for n in (2, 4, 5, 9, 40):
        c = langid.codewords(n).astype(int)
        assert len(set(map(tuple, c.tolist()))) == n and min(((a != b).sum()) for i, a in enumerate(c) for b in c[:i]) >= 1


def test_language_blocks(monkeypatch):
    text = "Straße und Übermut, ñandú " * 9
    whole = sorted(x for b in langid.buckets(text) for x in b.tolist())
    monkeypatch.setattr(langid, "BLOCK", 16)
    assert sorted(x for b in langid.buckets(text) for x in b.tolist()) == whole


def test_pipeline(spark, data):
    import hashlib

    import corpus_pipeline
    import numpy as np
    import public_tokenizers

    from encodelens.llm import bpe

    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, data).collect())
    rows = [r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = [r for r in rows if not any(rule.reject(quality.Text(r["text"])) for rule in (*quality.BASE, *quality.RULES))]
    pages, lines = {}, {}
    for source, text in {(r["source"], r["text"]) for r in rows}:
        pages[source] = pages.get(source, 0) + 1
        for line in {x for x in text.split("\n") if WORD.search(x)}:
            lines[source, line] = lines.get((source, line), 0) + 1
    bad = {k for k, n in lines.items() if n >= 5 and n > 0.05 * pages[k[0]]}
    for r in rows:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)
    ids = [r["doc_id"] for r in rows]
    group = classes(ids, alike([(r["doc_id"], r["text"]) for r in rows]))
    rows = {r["doc_id"]: r for r in rows if group[r["doc_id"]] == r["doc_id"]}
    mix = mixing.mix(spark.createDataFrame([(i, r["source"], len(WORD.findall(r["text"]))) for i, r in rows.items()], "doc_id long, source string, size long"))
    want = []
    for r in mix.collect():
        ids = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary(rows[r.doc_id]["text"])
        want += [(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * r.copies
    assert got == sorted(want)


def test_pipeline_odd_rows(spark):
    """Null, empty, long, repeated and clashing rows, and no rows at all, through every stage."""
    import corpus_pipeline

    good = " ".join(f"word{i} then" for i in range(30))
    rows = [*ODD, (20, good, None), (20, good, None), (None, good + " more", "a"), (21, "x" * 300_000 + " " + good, "a"), (22, good + "\x00 \U0001f600", "")]
    first = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("_keep"), F.lit("r").alias("row"))
    for some in (first, first.limit(0)):
        d = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = common.written(stage(spark, d, ""), name)
            assert d.columns == first.columns
        out = corpus_pipeline.STAGES[-1][1](spark, d, "")
        kept = {r.doc_id for r in d.collect()}
        assert out.count() == d.count() and kept <= {20, 21, 22, None} and (some is not first or 20 in kept)


def test_stages_with_columns_of_any_name(spark):
    """Dots, backticks and spaces in the names of other columns; each operator and stage that passes rows on."""
    import corpus_pipeline
    from encodelens.llm import hilbert, linededup, mixing, neartexts, quality, simhash

    words = [f"word{i} and more of them here" for i in range(60)]
    rows = [(i, " ".join(words[i % 7 :]) if i % 5 else None, "en", f"s{i % 2}", 3, i * 2, "x", i) for i in range(24)]
    odd = ["meta.v", "a`b", "with space"]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *odd])
    for f in (quality.accepted, neartexts.keep_one, simhash.keep_one, mixing.mixed):
        out = f(docs)
        assert out.columns == docs.columns and out.count() <= 72
        assert all(r["meta.v"] == 2 * r["doc_id"] == 2 * r["with space"] for r in out.collect())
    assert [c for c in linededup.drop_boilerplate(docs).columns if c[0] != "_"] == docs.columns
    assert set(odd) <= set(quality.judge(docs).columns)
    assert hilbert.shard(docs).count() == 24
    part = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        part = stage(spark, part, "")
        assert part.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, part, "").count() == part.count()


@pytest.mark.parametrize("name", "related-work social-history share-prices tags-explained alert-level copyright-law hidden-figures comment-letters reply-brief ad-hoc-notes widget-review plain".split())
def test_sections_of_an_article_stay_by_any_name(name):
    from encodelens.llm.htmltext import extract

    page = f"<body><nav>menu</nav><article><h1>Title</h1><p>First of all.</p><section class='{name}'><h2>Part</h2><p>What it says.</p></section></article></body>"
    assert extract(page, "body/article") == "Title\n\nFirst of all.\n\nPart\n\nWhat it says."


@pytest.mark.parametrize("box", ["ol class='commentlist'", "ol class='comment-list'", "div id='comments'", "div class='comments-area'", "div class='share-buttons'", "div class='ad-slot'", "div class='related-posts'", "div class='x social'"])
def test_furniture_in_an_article_goes(box):
    from encodelens.llm.htmltext import extract

    tag = box.split()[0]
    page = f"<body><article><h1>Title</h1><p>First of all.</p><{box}><li>Ann: well said</li></{tag}><p>The end.</p></article></body>"
    assert extract(page, "body/article") == "Title\n\nFirst of all.\n\nThe end."
