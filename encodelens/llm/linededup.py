"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encodelens.llm.common import named, whole_row, written

SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _has_word(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(SPACE))) > 0


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5, copies_once: bool = True) -> DataFrame:
    """(host, line_key, pages, host_pages): lines of over `ratio` of their host's pages, and of min_pages at least.

    Rows of one host and text are one page (with copies_once=False a page each), so that the lines of a much copied text
    are no boilerplate. A page counts once for a line, however often it holds it; a line is known by its MD5. Lines
    without a word are no boilerplate. On a host of few pages each line stands on a large part of them, so min_pages
    tells chance from habit; a host of fewer pages keeps all its lines. Counts are summed before the shuffle, so a line
    that all pages hold is no hot key.
    """
    pages = docs.select(named(host_col).alias("host"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    page = [_key(F.col("text")).alias("page")] if copies_once else []
    lines = pages.select("host", *page, F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).where(_has_word(F.col("line")))
    lines, pages = lines.select("host", *["page" for _ in page], _key(F.col("line")).alias("line_key")), pages.select("host", *page)
    if copies_once:
        lines, pages = lines.distinct(), pages.distinct()
    n = lines.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    total = pages.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    out = n.join(total, n["host"].eqNullSafe(total["_host"])).drop("_host")
    return out.where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5, broadcast_rows: int = 100_000, copies_once: bool = True) -> DataFrame:
    """docs with boilerplate lines cut out of their texts, and _lines and _dropped: lines with a word, and those cut.

    All rows stay; a text of boilerplate alone becomes empty, a null text stays null. Kept lines keep their order
    and bytes. Up to broadcast_rows boilerplate lines (about 15 MB) go to all tasks; more are joined by shuffles, in
    which the texts of rows with such lines take part once. Pages of a null host form a site of their own; repeated rows
    all stay. Other columns may have any names but _lines and _dropped. Lines of `ratio` or less of a host's
    pages stay: of a line that stands on 7 % of them all are cut at 0.05 and none at 0.1.
    """
    clash = {"_lines", "_dropped"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    found = written(boilerplate(docs, host_col, text_col, ratio, min_pages, copies_once).select("host", "line_key"), "boilerplate")
    cut = _cut_by_broadcast if found.count() <= broadcast_rows else _cut_by_join
    row = docs.select(whole_row(docs).alias("row"), named(host_col).alias("host"), named(text_col).alias("text"))
    out = cut(row, found)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns], F.col("n").alias("_lines"), F.col("cut").alias("_dropped"))


def _cut_by_broadcast(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (row, host, text) with the text cut, and n and cut, the lines with a word and those cut."""
    bad: dict = {}
    for r in found.toLocalIterator():
        bad.setdefault(r["host"], set()).add(bytes(r["line_key"]))
    shared = rows.sparkSession.sparkContext.broadcast(bad)
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.IntegerType()), T.StructField("cut", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped = [], [], []
            for host, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                these, kept, n, cut = shared.value.get(host, ()), [], 0, 0
                for line in (text or "").split("\n"):
                    word = bool(line.strip(SPACE))
                    n += word
                    if word and these and hashlib.md5(line.encode()).digest() in these:
                        cut += 1
                    else:
                        kept.append(line)
                texts.append("\n".join(kept) if cut else text)
                lines.append(n)
                dropped.append(cut)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(dropped, pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)


def _cut_by_join(rows: DataFrame, found: DataFrame) -> DataFrame:
    """By shuffles: lines of all texts meet the boilerplate by (host, key), and the hits return to the texts.

    A text is known by its MD5; texts that are equal on one host lose the same lines.
    """
    split = _lines(F.coalesce(F.col("text"), F.lit("")))
    d = rows.withColumn("page", _key(F.coalesce(F.col("text"), F.lit("")))).withColumn("parts", split)
    lines = d.select("page", F.col("host").alias("h"), F.posexplode("parts").alias("at", "line")).where(_has_word(F.col("line"))).select("page", "h", "at", _key(F.col("line")).alias("k")).distinct()
    hit = lines.join(found, lines["h"].eqNullSafe(found["host"]) & (lines["k"] == found["line_key"]), "left_semi")
    hits = hit.groupBy(F.col("page").alias("of"), "h").agg(F.collect_set("at").alias("gone"))
    out = d.join(hits, (d["page"] == hits["of"]) & d["host"].eqNullSafe(hits["h"]), "left")
    kept = F.filter("parts", lambda line, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select("row", "host", text.alias("text"), F.size(F.filter("parts", _has_word)).alias("n"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).alias("cut"))
