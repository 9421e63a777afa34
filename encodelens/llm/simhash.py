"""SimHash near-duplicates of texts by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encodelens.llm.common import broadcast_if_small, components, named, unpacked, whole_row, written

BITS, BYTES = 64, 8
#: Shingles hashed at once.
BLOCK = 1 << 17


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned integer; 0 if it has no word.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles count as often as they occur.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for i in range(0, n, BLOCK):
        some = np.array([h(line[s:e], seed) for s, e in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], dtype=">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, h, fp): a 64-bit hash of each row's whole text, and its 64-bit SimHash as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["id", "h", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, h long, fp long")


def covering(positions: range, size: int) -> list[tuple[int, ...]]:
    """Subsets of half the byte positions each: any 5 of the 8 positions hold one of these triples whole."""
    half = len(positions) // 2
    return [*combinations(positions[:half], size), *combinations(positions[half:], size)]


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _packed(positions: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftright("fp", 8 * p).bitwiseAND(F.lit(0xFF)))
    return out


def _linked(differing: int, least: int) -> str:
    """SQL: rows a and b tally at least `least` equal positional bytes, and then differ in few enough bits."""
    tally = " + ".join(f"cast(((a.fp ^ b.fp) & {_mask((p,))}) = 0 as int)" for p in range(BYTES))
    return f"{tally} >= {least} and bit_count(a.fp ^ b.fp) <= {differing}"


def _ours(masks: list[tuple[int, int]], column: str) -> str:
    """SQL: this posting list is the first that the pair shares, so that a pair comes once."""
    return "coalesce(" + ", ".join(f"if(((a.fp ^ b.fp) & {m}) = 0, {n}, null)" for n, m in masks) + f") = a.{column}"


def stars(postings: DataFrame, linked: Callable[[DataFrame], DataFrame], leaders: int = 1) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of nodes of postings (key, node, others) to the first of their lists; and the lists as they then are.

    First in `leaders` orders. linked: keeps of rows (a, b), structs of postings, pairs of nodes that are linked, as
    (a, b); it need not keep several for an a. The lists: (key, r, c) of lists of two and more, c being the component
    of r's node by the edges. A list of copies, however long, costs a pair a node.
    """
    row = F.struct(*[F.col(c) for c in postings.columns if c != "key"])
    p = postings.select("key", row.alias("r"))
    orders = [F.min("r"), *[F.min_by("r", F.xxhash64("r.node", F.lit(i))) for i in range(1, leaders)]]
    first = p.groupBy("key").agg(F.array_distinct(F.array(*orders)).alias("bs"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = written(p.join(first, "key"), "postings")
    pairs = shared.select(F.col("r").alias("a"), F.explode("bs").alias("b")).where("a.node <> b.node")
    edges = written(linked(pairs), "stars")
    part = components(edges).select(F.col("node").alias("_node"), "component")
    shared = shared.select("key", "r").join(part, F.col("r.node") == F.col("_node"), "left").select("key", "r", F.coalesce("component", "r.node").alias("c"))
    return edges, written(shared, "joined-postings")


def connect(postings: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) between nodes of postings (key, node, others) that join up all that any pair within a list would.

    After stars() only nodes that are not joined up yet meet within a list: those outside the component that has most
    of the list meet all others. No list is capped.
    """
    edges, shared = stars(postings, linked)
    per = shared.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = shared.join(per.select("key", "most"), "key")
    out = mixed.where("c <> most").select("key", F.col("r").alias("a"), F.col("c").alias("ca"))
    pairs = out.join(mixed.select("key", "most", F.col("r").alias("b"), F.col("c").alias("cb")), "key")
    pairs = pairs.where("ca <> cb and (cb = most or a.node > b.node)").select("a", "b")
    return edges.unionByName(linked(pairs))


def links(fps: DataFrame, differing: int = 3, hot: int = 256) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that join up all those that differ in at most `differing` bits.

    Fingerprints at 3 or fewer differing bits share at least 8 - 3 = 5 positional bytes, so they share a whole triple of
    positions within the lower or the upper half: those 8 triples key the inverted index. Each pair that meets in a
    posting list has its shared positional bytes tallied; pairs of fewer than 5 are dropped, and the rest is verified by
    its differing bits. From lists of up to `hot` fingerprints each linked pair comes once. Longer lists are cut by two
    further positions, as their pairs must share those too, and are joined up by connect(). No list is capped.
    """
    if not 0 <= differing <= 3:
        raise ValueError("the index guarantees pairs of up to 3 differing bits")
    test = _linked(differing, BYTES - differing)
    triples = covering(range(BYTES), 3)
    keyed = [F.struct(F.lit(n).alias("no"), F.lit(n << 24).cast("long").bitwiseOR(_packed(t)).alias("key")) for n, t in enumerate(triples)]
    posts = fps.select("fp", F.explode(F.array(*keyed)).alias("k")).select("fp", "k.no", "k.key")
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    sizes = written(sizes.select("key"), "hot-keys")
    cold = posts if sizes.isEmpty() else posts.join(sizes, "key", "left_anti")
    first = _ours([(n, _mask(t)) for n, t in enumerate(triples)], "no")
    a, b = cold.alias("a"), cold.alias("b")
    out = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & F.expr(f"{test} and {first}"))
    out = out.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if cold is posts:
        return out
    per = []
    for n, t in enumerate(triples):
        # of the 5 other positions 2 are equal
        more = combinations([p for p in range(BYTES) if p not in t], 2)
        per.append(F.array(*[F.lit((n * 16 + i) << 40).bitwiseOR(_packed(t + two)) for i, two in enumerate(more)]))
    warm = posts.join(sizes, "key", "left_semi").select("fp", F.explode(F.element_at(F.array(*per), F.col("no") + 1)).alias("key"))
    warm = warm.select("key", F.col("fp").alias("node"), "fp")

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(test).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()

    return out.unionByName(connect(warm, linked))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, differing: int, seed: int, hot: int) -> DataFrame:
    """(id, h, fp, root) of each row; root is the smallest fingerprint, as a signed long, that its own is joined up with."""
    fp = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    comp = components(links(fp.select("fp").distinct(), differing, hot)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return fp.join(comp, "fp", "left").select("id", "h", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, differing: int = 3, seed: int = 42, hot: int = 256) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    Texts link if their fingerprints differ in at most `differing` bits; component_id is the smallest id reachable.
    Copies share a fingerprint and meet by it, so that only distinct fingerprints are compared, and rows of a null id
    link others like all rows. Null and empty texts have fingerprint zero; repeated ids keep their rows; component_id is
    null if all ids of a component are. An empty table gives no rows; other columns are ignored.
    """
    rows = written(_grouped(docs, id_col, text_col, shingle, differing, seed, hot), "groups")
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(least, "root").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def _one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row for each root of rows (id, h, root): that of the smallest id, null last, with all its columns.

    Rows are met again by id and text hash. Only where the same id has the same text several times, one of them is drawn.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    best = written(rows.groupBy("root").agg(F.min(rank).alias("r")).select("root", F.col("r.id").alias("_keep"), F.col("r.h").alias("_hash")), "kept")
    stays = F.col("id").eqNullSafe(F.col("_keep")) & (F.col("h") == F.col("_hash"))
    met = rows.join(best, "root").withColumn("stays", stays).groupBy("id", "h").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    met = written(met.where("not stays or n > 1"), "gone-or-repeated")
    # rows that go are fewer than those that stay: while they are few, texts stay where they are
    gone, _ = broadcast_if_small(met.where("not stays").select(F.col("id").alias("_gone"), F.col("h").alias("_gone_h")), 32)
    many = met.where("stays").select(F.col("id").alias("_many"), F.col("h").alias("_many_h"))
    d = docs.select(whole_row(docs).alias("row"), named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("h"))
    kept = d.join(gone, F.col("id").eqNullSafe(F.col("_gone")) & (F.col("h") == F.col("_gone_h")), "left_anti")
    if not many.isEmpty():
        many, _ = broadcast_if_small(many, 32)
        here = F.col("id").eqNullSafe(F.col("_many")) & (F.col("h") == F.col("_many_h"))
        one = kept.join(many, here, "left_semi").withColumn("text", F.col("row").getField(text_col)).dropDuplicates(["id", "text"]).drop("text")
        kept = kept.join(many, here, "left_anti").unionByName(one)
    return kept.select(*unpacked("row", docs.columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, differing: int = 3, seed: int = 42, hot: int = 256) -> DataFrame:
    """The documents without near-duplicates: of each group one row stays, that of the smallest id, with all its columns.

    A null id comes after all others; of rows of equal id, the one whose text has the smallest hash stays, and of rows of
    equal id and text one. Columns may have any names; an empty table stays empty.
    """
    return _one_of_each(docs, _grouped(docs, id_col, text_col, shingle, differing, seed, hot), id_col, text_col)
