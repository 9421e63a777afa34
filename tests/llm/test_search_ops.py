"""Source divergence, hard negatives and top-k search against loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from encodelens.llm import divergence, negatives, queries, residues, topk
from encodelens.llm.oracles import DIVERGENCE, NEGATIVES, TOP_K


@pytest.mark.parametrize("name, sql", [("op11_source_divergence", DIVERGENCE), ("op12_hard_negatives", NEGATIVES), ("op13_exact_top_k", TOP_K)])
def test_queries_against_sql(spark, data, duck, same, name, sql):
    same(queries.QUERIES[name](spark, data), duck, sql)


def whole(rng, n, d, most):
    return rng.integers(-most, most + 1, (n, d)).astype(np.float64)


@pytest.mark.parametrize("d, most", [(1, 3), (64, 500), (65, 300), (200, 1 << 20), (3, 1 << 29), (0, 5)])
def test_residue_products_are_exact(d, most):
    rng = np.random.default_rng(d)
    a, b = whole(rng, 7, d, most), whole(rng, 9, d, most)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert residues.product(residues.Residues(a), residues.Residues(b)).tolist() == want
    assert all(residues.TERMS * (p // 2) ** 2 < 2**24 for p in residues.PRIMES)


def test_residue_products_too_large():
    big = np.full((1, 4), 2.0**40)
    with pytest.raises(OverflowError):
        residues.product(residues.Residues(big), residues.Residues(big))


def test_ball_tree_finds_the_best_and_skips():
    rng = np.random.default_rng(5)
    centers = whole(rng, 30, 16, 400)
    rows = np.concatenate([centers[rng.integers(0, 30, 1500)] + whole(rng, 1500, 16, 3), np.repeat(centers[:1], 200, axis=0)])
    ids, at = rng.permutation(len(rows)) // 2, np.arange(len(rows))
    s = topk.Searcher(rows, ids, at, 5, leaf=16)
    asked = np.arange(0, len(rows), 17)
    least = np.full(len(asked), topk.NONE)
    scores = (rows[asked] @ rows.T).astype(np.int64)
    want = [sorted((-int(scores[i, j]), int(ids[j]), j) for j in range(len(rows)) if j != asked[i])[:5] for i in range(len(asked))]
    q, score, row = s.search(rows[asked], asked, least)
    got = defaultdict(list)
    for i, x, j in zip(q.tolist(), score.tolist(), row.tolist()):
        got[i].append((-x, int(ids[j]), j))
    assert [sorted(got[i]) for i in range(len(asked))] == want
    assert s.visited < s.asked / 2
    s.visited = 0
    bound = np.array([-w[-1][0] for w in want])
    q, score, row = s.search(rows[asked], asked, bound)  # what another shard has shared cuts the search and no row
    assert Counter(q.tolist()) == Counter(i for i, w in enumerate(want) for _ in w)
    assert s.visited < s.asked / 2


def odd_vectors(seed, n=160, d=6, most=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) / 256 for x in rng.integers(-most, most + 1, d)], int(rng.choice([1, 1, 1, 2, 3]))) for i in range(n)]
    rows += [(rows[3][0], rows[3][1], 1), (rows[10][0], rows[10][1], 2), (10, rows[10][1], 2), (0, rows[1][1], 1)]  # repeated rows and ids
    rows += [(1000 + i, rows[20][1], 1) for i in range(90)]  # a hot vector and label
    rows += [(None, rows[0][1], 1), (200, None, 1), (300, [None] * d, 1), (400, [float("nan")] * d, 2), (500, [float("inf")] * d, 1), (600, rows[0][1], None), (700, [], 1), (800, [], 2), (900, [0.5], 1), (50, [-0.001] * d, 3)]
    return rows


def usable(rows, label):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and not (label and r[2] is None)]
    return [(i, [int(np.floor(256 * x)) for x in v], lab, k) for k, (i, v, lab) in enumerate(ok)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("rows_a_shard, block", [(4096, 256), (13, 4)])
def test_top_k_against_loops(spark, rows_a_shard, block):
    rows = odd_vectors(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, `at.id` string").withColumnRenamed("at.id", "at")
    e, want = usable(rows, False), []
    for q in (r for r in e if r[0] % 50 == 0):
        found = sorted((-dot(q[1], r[1]), r[0]) for r in e if r[3] != q[3] and len(r[1]) == len(q[1]))[:5]
        want += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(found)]
    got = topk.top_k(df, F.col("id") % 50 == 0, rows_a_shard=rows_a_shard, leaf=4, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def loops_negatives(rows):
    e, want = usable(rows, True), []
    for a in (r for r in e if r[0] % 100 == 0):
        scored = sorted((-dot(a[1], r[1]), r[0], r[3], r[2]) for r in e if r[3] != a[3] and len(r[1]) == len(a[1]))
        for p in [s for s in scored if s[3] == a[2]][:5]:
            inside = [s for s in scored if s[3] != a[2] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            want += [(a[0], p[1], n + 1, s[1], -p[0], -s[0]) for n, s in enumerate(inside)]
    return want


@pytest.mark.parametrize("rows_a_shard, block, most", [(4096, 256, 3), (13, 4, 3), (20, 256, 10**8)])
def test_hard_negatives_against_loops(spark, rows_a_shard, block, most):
    rows = odd_vectors(2, most=most)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("length", F.lit("y"))
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0, rows_a_shard=rows_a_shard, block=block)
    want = loops_negatives(rows)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_windows_of_scores_too_large_to_pack():
    rng = np.random.default_rng(3)
    small = rng.integers(-20, 20, (6, 40))
    ids, at, out = rng.integers(0, 30, 40), np.arange(40), rng.random((6, 40)) < 0.3
    lows, highs = np.tile([-5, 0, 3], (6, 1)), np.tile([5, 4, 1], (6, 1))
    a = negatives.best_in_windows(small, ids, at, out, lows, highs, 4)
    b = negatives.best_in_windows(small << 55, ids, at, out, lows << 55, highs << 55, 4)
    key = lambda t: sorted(zip(t[0].tolist(), t[1].tolist(), t[2].tolist(), t[3].tolist()))
    assert key(a) == key((b[0], b[1], b[2] >> 55, b[3]))
    for score in (-7, 0, 1, 99, 100, 101, 10**17 + 7):
        s = np.array([score])
        assert negatives.percent(s, 30, True)[0] == -(-30 * score // 100) and negatives.percent(s, 90, False)[0] == 90 * score // 100


def loops_divergence(rows, min_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        langs[lang].add(source)
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        total = Counter()
        for s in sources:
            total.update(count[lang, s])
        n_of = lambda c: sum(c[t] for t in kept)
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n_of(count[lang, s]) + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (total[t] + 1) // (n_of(total) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", i.decode(), -v, n + 1) for n, (v, i) in enumerate(pairs)]
            out += [(lang, s, "term", i.decode(), -v, n + 1) for n, (v, i) in enumerate(terms[:top])]
    return out


def odd_texts():
    rng = np.random.default_rng(9)
    words = ["the", "The", "É", "été", "ﬀ", "日本", "𐐀x", "a1b", "don't", "x_y", "ſ", "K", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), str(rng.choice(["en", "de"])), str(rng.choice(["s1", "s1", "s1", "s2", "s3"]))) for _ in range(120)]
    rows += rows[:5] + [(None, "en", "s4"), ("", "en", "s5"), ("the the", None, None), ("the", None, "s"), ("the", "", "s"), ("1 2 \x00 \x85 3", "xx", "a"), (None, "xx", "b"), ("lonely", "yy", "only")]
    rows += [(("hot " * 3000) + "the cold", "en", "s1"), ("é" * 5000, "de", "s2")]
    return rows


@pytest.mark.parametrize("held, slice_bytes, part, most", [(400_000, 1 << 20, 8, 1 << 20), (5, 40, 2, 3)])
def test_divergence_against_loops(spark, monkeypatch, held, slice_bytes, part, most):
    rows = odd_texts()
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int")
    f = divergence.term_counts
    monkeypatch.setattr(divergence, "term_counts", lambda *a: f(*a, held=held, slice_bytes=slice_bytes))
    sums = divergence._pair_sums
    monkeypatch.setattr(divergence, "_pair_sums", lambda *a: sums(*a, most_words=most))
    got = divergence.audit(df, top_terms=7, sources_a_task=part)
    assert sorted(map(tuple, got.collect())) == sorted(loops_divergence(rows, top=7))
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_in_narrow_blocks(spark, monkeypatch):
    rows = odd_texts()
    number = divergence.numbered
    monkeypatch.setattr(divergence, "numbered", lambda t, g: number(t, g, widest=64, most_bits=64))
    df = spark.createDataFrame(rows, "body string, `lang.x` string, `so``urce` string")
    got = divergence.audit(df, lang_col="lang.x", source_col="so`urce", text_col="body")
    assert sorted(map(tuple, got.collect())) == sorted(loops_divergence(rows))
