"""Near-duplicate texts by word shingles: a wide SimHash and its byte-position index give candidates, shingles verify them.

A similarity of 0.8 leaves about one bit in nine different, more than one for each byte, so no number of equal bytes is
certain, as it is for the 3 bits of 64 in simhash.py. The fingerprint has so many byte positions that a pair meets in the
index, and reaches the tally, with high probability instead; the README has the recall. What is found is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encodelens.llm.common import broadcast_if_small, components, drop_written, named, passing, written
from encodelens.llm.simhash import _one_of_each, stars

#: Byte positions of the wide fingerprint, triples of them that key the index, and equal bytes that a pair must have.
BYTES, KEYS, LEAST = 96, 128, 12
#: Least shingle hashes that a sketch holds, and how far below the similarity the estimate of a cut sketch may lie (four
#: standard deviations). The sketch of a text of no more shingles is their whole set.
MINIMA, SLACK = 256, 0.1
#: Rows of a posting list that meet in one task.
LIST = 2048
#: Shingles hashed at once.
BLOCK = 1 << 13
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Integers with their bits spread over each other (a multiply and shift finish)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, in order; fewer words are one run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) << np.uint64(32) | np.fromiter(map(len, words), np.uint64, len(words))
    size = min(size, len(words))
    n, out = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = _mixed(out + _mixed(h[k : k + n] * _ODD[k % len(_ODD)]))
    return out


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of shingle hashes in BYTES bytes: a bit is 1 if set in over half of them."""
    ones = np.zeros(8 * BYTES, np.int64)
    lanes = np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * _ODD[0]
    for i in range(0, len(hashes), BLOCK):
        rows = _mixed(hashes[i : i + BLOCK, None] + lanes).view(np.uint8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """The MINIMA least distinct 32-bit hashes of shingles, ascending."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4"))[:MINIMA].tobytes()


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of pairs of sketches: rows of a and b, filled up with the greatest integer, with their lengths."""
    none = np.uint32(2**32 - 1)
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
    # of cut sketches only the least MINIMA of the union count
    cut = (na == MINIMA) | (nb == MINIMA)
    rank = np.cumsum(np.concatenate([np.ones((len(both), 1), bool), both[:, 1:] != both[:, :-1]], axis=1), axis=1)[:, 1:]
    met = np.where(cut, (same & (rank <= MINIMA)).sum(axis=1), same.sum(axis=1))
    union = na + nb - same.sum(axis=1)
    return met / np.maximum(1, np.where(cut, np.minimum(union, MINIMA), union)) + np.where(cut, SLACK, 1e-3)


def tally(fp: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) of rows have LEAST equal positional bytes."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x), BLOCK):
        out[i : i + BLOCK] = (fp[x[i : i + BLOCK]] == fp[y[i : i + BLOCK]]).sum(axis=1) >= LEAST
    return out


@lru_cache(maxsize=1)
def triples() -> np.ndarray:
    """KEYS triples of byte positions; each position stands in equally many."""
    rng = np.random.default_rng(5)
    rounds = -(-3 * KEYS // BYTES)
    return np.concatenate([rng.permutation(BYTES) for _ in range(rounds)]).reshape(-1, 3)[:KEYS]


def texts_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, h, same, fp, sk) of each row: text hash, digest of the words in lower case, wide fingerprint of 3-word shingles, sketch.

    Runs of 3 words change less under an edit than those of 5, so that a pair of a given similarity meets more surely. The
    sketch is of shingles of `size` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, fps, sks = [], [], []
            for text in b.column(2).to_pylist():
                words = (text or "").encode().lower().split()
                same.append(hashlib.md5(b" ".join(words)).digest())
                fps.append(wide_fingerprint(shingles(words, 3)))
                sks.append(sketch(shingles(words, size)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.binary()) for x in (same, fps, sks))], ["id", "h", "same", "fp", "sk"])

    slim = docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col)).alias("h"), named(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, h long, same binary, fp binary, sk binary")


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node) for each triple of positions: which triple, and its three bytes, in one integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, no = triples(), np.arange(KEYS, dtype=np.uint32) << np.uint32(24)
        for b in batches:
            fp = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BYTES).astype(np.uint32)
            keys = no | fp[:, at[:, 0]] << np.uint32(16) | fp[:, at[:, 1]] << np.uint32(8) | fp[:, at[:, 2]]
            lists = pa.ListArray.from_arrays(np.arange(len(fp) + 1, dtype=np.int32) * KEYS, pa.array(keys.ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["node", "keys"])

    return nodes.select("node", "fp").mapInArrow(run, "node long, keys array<int>").select(F.explode("keys").alias("key"), "node")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), kind)
    return raw.reshape(len(column), -1)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows filled up with the greatest integer, and their lengths."""
    rows = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    out = np.full((len(rows), MINIMA), 2**32 - 1, np.uint32)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out, np.array([len(x) for x in rows])


def tallied(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that tally()."""
    f = nodes.select("node", "fp")
    met = pairs.join(f.toDF("a", "fa"), "a").join(f.toDF("b", "fb"), "b").select("a", "b", "fa", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = x.num_rows
            if n:
                fp = np.concatenate([_matrix(x.column(2), np.uint8), _matrix(x.column(3), np.uint8)])
                kept = pa.array(tally(fp, np.arange(n), np.arange(n) + n), pa.bool_())
                yield pa.RecordBatch.from_arrays([x.column(0).filter(kept), x.column(1).filter(kept)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def within_lists(lists: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components within posting lists (key, node, c, n) of n rows each that tally and may be similar.

    Lists are cut into blocks of LIST rows, and each two blocks meet in one task. A pair is taken in the first list that
    it shares, tallied, and estimated by its sketches, so that a group of texts which are much alike, but not enough,
    sends nothing. Where sketches are the whole sets, two components of a list send the most similar pair alone.
    """
    blocks = F.ceil(F.col("n") / LIST).cast("int")
    rows = lists.withColumn("m", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("b", o).alias("l"), F.greatest("b", o).alias("r")))
    rows = rows.withColumn("t", F.explode(meets)).join(nodes.select("node", "fp", "sk"), "node")
    rows = rows.select("key", "t.l", "t.r", "b", "node", "c", "fp", "sk")
    dealt = rows.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r", "node")

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, l, r, b, node, c = (t.column(i).to_numpy() for i in range(6))
        fp, at = _matrix(t.column(6).combine_chunks(), np.uint8), triples()
        sk, size = _sets(t.column(7))
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (l[1:] != l[:-1]) | (r[1:] != r[:-1]))))
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def take(x: np.ndarray, y: np.ndarray) -> None:
            for i in range(0, len(x), BLOCK):
                p, q = x[i : i + BLOCK], y[i : i + BLOCK]
                good = tally(fp, p, q)
                p, q = p[good], q[good]
                ours = (fp[p][:, at] == fp[q][:, at]).all(axis=2).argmax(axis=1) == (key[p].view(np.uint32) >> 24)
                p, q = p[ours], q[ours]
                like = estimate(sk[p], sk[q], size[p], size[q])
                kept.append(tuple(z[like >= similarity] for z in (p, q, like)))

        left, waiting, n = np.arange(len(key)), [], 0
        for step in range(1, len(key)):  # rows that stand `step` apart in one list; a block of pairs at a time is held
            left = left[left + step < len(key)]
            left = left[group[left] == group[left + step]]
            if not len(left):
                break
            x = left[(c[left] != c[left + step]) & ((l[left] == r[left]) | (b[left] != b[left + step]))]
            waiting.append((x, x + step))
            n += len(x)
            if n >= BLOCK:
                take(*(np.concatenate(z) for z in zip(*waiting)))
                waiting, n = [], 0
        if n:
            take(*(np.concatenate(z) for z in zip(*waiting)))
        x, y, like = (np.concatenate(z) for z in zip(*kept))
        # of pairs that join the same two components the most similar does, where sketches are whole sets
        whole = np.maximum(size[x], size[y]) < MINIMA
        order = np.lexsort((-like, np.maximum(c[x], c[y]), np.minimum(c[x], c[y]), group[x]))
        order = order[whole[order]]
        lo, hi, of = np.minimum(c[x], c[y])[order], np.maximum(c[x], c[y])[order], group[x][order]
        best = np.ones(len(order), bool)
        best[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (of[1:] != of[:-1])
        sent = np.concatenate([order[best], np.flatnonzero(~whole)])
        x, y = x[sent], y[sent]
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in batches:
            if not x.num_rows:
                continue
            # rows up to the last change of list are whole lists; the rest waits for more
            key = np.stack([x.column(i).to_numpy().astype(np.int64) for i in range(3)])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and (np.array([held[-1].column(i)[held[-1].num_rows - 1].as_py() for i in range(3)]) != key[:, 0]).any():
                yield pairs(pa.Table.from_batches(held))
                held = []
            if len(change):
                yield pairs(pa.Table.from_batches([*held, x.slice(0, change[-1])]))
                held, x = [], x.slice(change[-1])
            held.append(x)
        if held:
            yield pairs(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) of nodes those with at least `similarity` of their shingles of `size` words, as sets, in common.

    Sketches that are whole sets tell it themselves. For pairs with a longer text the shingles of both are made again
    from texts (id, h, text), which are met by id and hash; only long texts and their partners take part in that join.
    """
    s = nodes.select("node", "sk")
    near = pairs.join(s.toDF("a", "ka"), "a").join(s.toDF("b", "kb"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                (a, na), (b, nb) = map(_sets, x.columns[2:])
                like = estimate(a, b, na, nb)
                cut = (na == MINIMA) | (nb == MINIMA)
                kept = pa.array(np.where(cut, like >= similarity, like - 1e-3 >= similarity - 1e-9))
                yield pa.RecordBatch.from_arrays([x.column(0).filter(kept), x.column(1).filter(kept), pa.array(cut).filter(kept)], ["a", "b", "cut"])

    near = written(near.select("a", "b", "ka", "kb").mapInArrow(compare, "a long, b long, cut boolean"), "candidates")
    sure, long = near.where("not cut").select("a", "b"), near.where("cut").select("a", "b")
    ends = long.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(nodes.select("node", "id", "h").join(ends, "node"), "candidate-texts")
    if wanted.isEmpty():
        return sure
    w, _ = broadcast_if_small(wanted.select("node", F.col("id").alias("_id"), F.col("h").alias("_h")), 40)
    # the partner of a text of MINIMA shingles and more has about as many; each word takes two characters at least
    some = texts.where(F.length("text") >= F.lit(MINIMA))
    found = some.join(w, some["id"].eqNullSafe(F.col("_id")) & (some["h"] == F.col("_h"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            of = [np.unique(shingles((t or "").encode().lower().split(), size)).view(np.int64) for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(of, pa.list_(pa.int64()))], ["node", "s"])

    # rows of equal id and text give equal sets: one of them does
    s = written(found.mapInArrow(sets, "node long, s array<long>").dropDuplicates(["node"]), "shingles")
    both = long.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return sure.unionByName(both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, h, root) of each row: rows of one root are joined up by pairs of at least `similarity` in word shingles.

    Words are compared in lower case (A-Z); texts of equal words are one node, so that only different ones are compared;
    texts without a word are equal. First each node meets that of three leaders of its posting lists with which it shares
    most; then nodes of different components meet within their lists. Pairs are tallied by equal bytes, those of lists
    of three and more also estimated by sketches, before their shingles verify them.
    """
    rows = written(texts_of(docs, id_col, text_col, size), "texts")
    first = F.min_by(F.struct("id", "h", "fp", "sk"), F.struct(F.col("id").isNull(), "id", "h"))
    nodes = rows.groupBy("same").agg(first.alias("r")).select("same", "r.*").withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")  # the numbers hold from here on
    texts = docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col)).alias("h"), named(text_col).alias("text"))

    def leaders(pairs: DataFrame) -> DataFrame:
        shared = pairs.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        best = shared.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
        return verified(tallied(best, nodes), nodes, texts, size, similarity)

    with passing() as made:
        edges = written(_edges(nodes, texts, leaders, size, similarity), "pairs")
        made.remove(edges)
    comp = components(edges).select("node", "component")
    drop_written(edges)
    roots = nodes.join(comp, "node", "left").select("same", F.coalesce("component", "node").alias("root"))
    return rows.select("id", "h", "same").join(roots, "same").select("id", "h", "root")


def _edges(nodes: DataFrame, texts: DataFrame, leaders: Callable[[DataFrame], DataFrame], size: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that join up all that grouped() finds."""
    edges, lists = stars(postings(nodes), leaders, leaders=3)
    lists = lists.select("key", "r.node", "c")
    mixed = lists.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).where("c0 <> c1")
    mixed = written(mixed.select("key", "a", "b", "n"), "mixed-lists")
    two = tallied(mixed.where("n = 2").select("a", "b").distinct(), nodes)
    more = within_lists(lists.join(mixed.where("n > 2").select("key", "n"), "key"), nodes, similarity)
    return edges.unionByName(verified(two.unionByName(more).distinct(), nodes, texts, size, similarity))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near-duplicates: of each group one row stays, that of the smallest id, with all its columns.

    A null id comes after all others; of rows of equal id and text one stays. Null and empty texts are one group; an
    empty table stays empty; columns may have any names. Tables on the way are deleted once they are read.
    """
    with passing() as made:
        groups = written(grouped(docs, id_col, text_col, size, similarity), "groups")
        made.remove(groups)
    return _one_of_each(docs, groups, id_col, text_col)
