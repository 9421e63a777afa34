"""How far the sources of a language lie apart by their terms: bitmaps per (group, count), joint cells by AND and popcount."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.llm.common import named, small_batches, written

#: Bytes outside terms (ASCII but letters) become spaces, A-Z become a-z; all bytes of other characters belong to terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of about size bytes at a time, cut between terms."""
    text, at = text.translate(_TERMS), 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = 700_000, slice_bytes: int = 1 << 20) -> DataFrame:
    """(lang, source, term, n, df): occurrences of a term in a group, and documents of the group that hold it.

    A term is a run of characters other than ASCII non-letters; A-Z count as a-z. A task adds up its documents and
    sends what it has once it holds `held` entries, so counts are summed before the shuffle, which deals by language and
    term. Each group also has a row of a null term, as it may have no terms.
    """
    small_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).cast("binary").alias("text"))

    def batch(group: tuple[str, str], n: Counter, df: Counter) -> pa.RecordBatch:
        terms = pa.array([None, *n], pa.binary()).cast(pa.string())
        names = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in group]
        return pa.RecordBatch.from_arrays([*names, terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set = set()
                for terms in _slices(text.as_py(), slice_bytes):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
            if sum(len(n) + 8 for n, _ in groups.values()) > held:
                for group, (n, df) in groups.items():
                    yield batch(group, n, df)
                groups = {}
        for group, (n, df) in groups.items():
            yield batch(group, n, df)

    out = rows.mapInArrow(run, "lang string, source string, term string, n long, df long")
    # dealt first, as tasks have added up already and a partial sum would find nothing to add
    return out.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column, unit: int = 1_000_000_000) -> Column:
    """1 + floor(unit * (count + 1) / (total + terms)), exact: decimals for counts whose product leaves a long."""
    far = F.call_function("div", F.lit(unit).cast("decimal(18,0)") * (count + 1).cast("decimal(19,0)"), (total + terms).cast("decimal(19,0)"))
    near = F.call_function("div", F.lit(unit).cast("long") * (count + 1), total + terms)
    return F.lit(1) + F.when(count < 2**63 // unit - 1, near).otherwise(far)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), exact: shares stay near 10 ** 9, so the square fits into a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def bitmaps(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, block, source, n, word, bits): which terms of a block occur n times in a group, as words of 64 bits.

    Only words with a bit are rows. Zero is no count here.
    """
    word = F.shiftright("pos", 6).cast("long").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("pos"), F.lit(64)).cast("int"))
    rows = counts.select("lang", "source", "term", "n").join(terms.select("lang", "term", "block", "pos"), ["lang", "term"])
    return rows.groupBy("lang", "block", "source", "n", word).agg(F.bit_or(bit).alias("bits"))


def numbered(terms: DataFrame, groups: DataFrame, widest: int = 1 << 15, most_bits: int = 1 << 21) -> DataFrame:
    """terms (lang, term, total) with block and pos, a number within the block from 0.

    Terms share a block with terms of like totals, so that its groups have few different counts: up to a total of 64 a
    block is as wide as most_bits leaves for the language's groups, 64 to `widest`; above, 64 to 128 wide, as each term may
    have a count of its own there.
    """
    level = terms.withColumn("level", F.length(F.bin("total")))
    n = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    wide = F.greatest(F.lit(64), F.least(F.lit(widest), F.floor(F.lit(most_bits) / F.col("groups"))))
    parts = level.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("_n")).join(n, "lang")
    parts = parts.select("lang", "level", F.ceil(F.col("_n") / F.when(F.col("level") <= 6, wide).otherwise(F.least(wide, F.lit(128)))).cast("long").alias("parts"))
    block = F.xxhash64("level", F.pmod(F.xxhash64("term"), F.col("parts")))
    out = level.join(parts, ["lang", "level"]).withColumn("block", block)
    return out.withColumn("pos", F.row_number().over(W.partitionBy("lang", "block").orderBy("term")) - 1).drop("level", "parts")


def _pair_sums(key: tuple, left: pa.Table, right: pa.Table, most_words: int = 1 << 20) -> pa.Table:
    """Per pair of groups (source of the part, item) the distance summed over a block's terms.

    left: bitmaps of the block. right: one row with the sources of the language, their totals, the language's number of
    terms, the block's, and this task's part of the sources. Each joint cell of two counts is an AND and a popcount;
    cells with a zero are what the others leave of a count's terms, and of the block's.
    """
    head = {c.removesuffix("_of"): v for c, v in right.to_pylist()[0].items()}
    names = [g["source"] for g in head["groups"]]
    totals, kept, width = [g["total"] for g in head["groups"]], head["terms"], head["width"]
    p_of = lambda i, c: 1 + 1_000_000_000 * (c + 1) // (totals[i] + kept)
    at = {s: i for i, s in enumerate(names)}
    source = np.array([at[s] for s in left["source"].to_pylist()], np.int64)
    n, word, bits = left["n"].to_numpy(), left["word"].to_numpy(), left["bits"].to_numpy().view(np.uint64)
    order = np.lexsort((word, n, source))
    source, n, word, bits = source[order], n[order], word[order], bits[order]
    new = np.ones(len(n), bool)
    new[1:] = (source[1:] != source[:-1]) | (n[1:] != n[:-1])
    level = np.cumsum(new) - 1
    maps = np.zeros((int(new.sum()), -(-width // 64)), np.uint64)
    maps[level, word] = bits
    of, counts = source[new], n[new]  # of each map: its group and count
    p = np.array([p_of(i, c) for i, c in zip(of.tolist(), counts.tolist())], np.int64)
    p0 = np.array([p_of(i, 0) if kept else 1 for i in range(len(names))], np.int64)
    ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    starts = np.searchsorted(of, np.arange(len(names) + 1))
    filled = np.zeros(len(names), np.int64)
    np.add.at(filled, of, ones)

    def f(p: np.ndarray | int, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    out = []
    for g in range(head["first"], min(head["first"] + head["some"], len(names))):
        left_over = ones.copy()  # of each map, its terms that do not occur in g
        value, union = np.zeros(len(names), np.int64), filled + filled[g]
        step = max(1, most_words // max(1, maps.size))
        for x in range(starts[g], starts[g + 1], step):
            own = slice(x, min(x + step, starts[g + 1]))
            joint = np.bitwise_count(maps[own, None] & maps).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(joint)
            cell = joint[i, j]
            np.add.at(value, of[j], cell * f(p[own][i], p[j]))
            met = np.zeros((len(joint), len(names)), np.int64)
            np.add.at(met, (i, of[j]), cell)
            value += ((ones[own, None] - met) * f(p[own, None], p0)).sum(axis=0)
            union -= met.sum(axis=0)
            left_over -= joint.sum(axis=0)
        np.add.at(value, of, left_over * f(p0[g], p))
        value += (width - union) * f(p0[g], p0)
        out.append(pa.table({"lang": [head["lang"]] * len(names), "source": [names[g]] * len(names), "item": names, "value": value}).filter(pa.array(np.arange(len(names)) != g)))
    return pa.concat_tables(out)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top_terms: int = 200, sources_a_task: int = 8) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language, and by which terms.

    A language keeps the V terms of at least min_docs of its documents. A group, or the language, with N occurrences of
    them gives each a share p = 1 + floor(10 ** 9 * (count + 1) / (N + V)); f(p, q) = floor((p - q) ** 2 / q). Part
    `pair` has each ordered pair of sources, with f summed over all kept terms; part `term` each source's top_terms
    terms of greatest f against the language among those it holds with a greater share. Ranks go by value, greatest
    first, ties by the item's UTF-8 bytes. All arithmetic is in whole numbers.

    Bitmaps are kept per group and count over blocks of terms; a task takes a block and sources_a_task of the sources
    against all, and sends a sum a pair. A pair's shares depend on the two counts only, so it costs joint cells, not
    terms. Output and work on pairs grow with the square of a language's sources, as the pairs are what is asked for.

    Null languages, sources and texts are read as ''. Repeated rows count as often as they are there. A source without
    terms has its pairs; without kept terms in a language all pair values are 0. Other columns play no part; an empty
    table gives an empty result.
    """
    counts, whole = term_counts(docs, lang_col, source_col, text_col), W.partitionBy("lang", "term")
    counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("_df", F.sum("df").over(whole))
    counts = written(counts.where(F.col("term").isNull() | (F.col("_df") >= min_docs)).select("lang", "source", "term", "n", "total"), "terms")
    groups, occurring = counts.where("term is null").select("lang", "source"), counts.where("term is not null")
    terms = written(numbered(occurring.groupBy("lang", "term").agg(F.first("total").alias("total")), groups), "kept-terms")
    totals = groups.join(occurring.groupBy("lang", "source").agg(F.sum("n").alias("_sum")), ["lang", "source"], "left")
    languages = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("everything"))
    groups = written(totals.join(languages, "lang", "left").select("lang", "source", F.coalesce("_sum", F.lit(0)).alias("sum"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("everything", F.lit(0)).alias("everything")), "groups")

    # a head for each block and part of the sources; block 0 of no terms, so that a language without any has its pairs
    lists = groups.groupBy("lang", "terms").agg(F.array_sort(F.collect_list(F.struct("source", F.col("sum").alias("total")))).alias("groups"))
    blocks = terms.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width")).unionByName(lists.select("lang", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("width")))
    first = F.explode(F.sequence(F.lit(0), F.size("groups") - 1, F.lit(sources_a_task)))
    heads = blocks.join(lists, "lang").withColumn("first", first).withColumn("some", F.lit(sources_a_task))
    maps = written(bitmaps(counts, terms), "bitmaps")
    dealt = maps.join(heads.select("lang", "block", "first"), ["lang", "block"])
    n = -(-heads.count() // 8)  # by number, so that little data is not put into one task
    heads = heads.repartition(max(1, n), "lang", "block", "first")
    dealt = dealt.repartition(max(1, n), "lang", "block", "first")
    other = heads.toDF(*[f"{c}_of" for c in heads.columns])  # names of their own, as both sides come from one table
    tasks = dealt.groupBy("lang", "block", "first").cogroup(other.groupBy("lang_of", "block_of", "first_of"))
    sums = tasks.applyInArrow(lambda key, left, right: _pair_sums(key, left, right), "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    by_term = occurring.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("sum"), F.col("terms")), share(F.col("total"), F.col("everything"), F.col("terms"))
    by_term = by_term.withColumn("p", p).withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = by_term.withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    out = pairs.withColumn("rank", rank).select("lang", "source", "part", "item", "value", "rank")
    return out.unionByName(best.select(*out.columns))
