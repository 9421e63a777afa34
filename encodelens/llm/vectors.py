"""Near-duplicate vectors: spherical k-means cells, and blocked cosine products within them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encodelens.llm.common import components, written


def unit(rows: list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length as unit vectors in double precision, and which of them have a direction."""
    m = np.asarray(rows, np.float64)
    ok = np.isfinite(m).all(axis=1)
    m = np.where(ok[:, None], m, 0.0)
    top = np.abs(m).max(axis=1, initial=0.0)  # before squaring, so that no square overflows or vanishes
    m = m / np.where(top > 0, top, 1)[:, None]
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n > 0, n, 1)[:, None], ok & (n > 0)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors: each vector goes to the centroid of greatest cosine, each centroid to the mean."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 1e-12, total / np.where(n > 1e-12, n, 1), c)
    return c


def by_length(lists: pa.ListArray, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length, straight from the buffer; -0 becomes 0."""
    lengths, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0
    ends = np.cumsum(lengths)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, values[(ends[at] - length)[:, None] + np.arange(length)]


def centroids(vectors: DataFrame, rows_a_cell: int, sample_rows: int, most_cells: int) -> dict[int, np.ndarray]:
    """Per vector length, the centroids learnt from at most sample_rows vectors, those of the smallest id hashes; equal ones count once."""
    n = vectors.count()
    got = vectors.select("vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().column(0).combine_chunks()
    out = {}
    for length, _, rows in by_length(got.chunk(0) if isinstance(got, pa.ChunkedArray) else got, "<f8"):
        m, ok = unit(rows)
        first = list({r.tobytes(): i for i, r in reversed(list(enumerate(m))) if ok[i]}.values())[::-1]
        k = int(min(most_cells, max(1, n // rows_a_cell), max(1, len(first) // 8)))
        if first:
            out[length] = spherical_kmeans(m[sorted(first)], k)
    return out


def nearest(rows: np.ndarray, centres: np.ndarray, probes: int, cells_at_once: int = 1 << 21) -> np.ndarray:
    """The `probes` centroids of greatest cosine of each row, best first; as many rows at a time as cells_at_once cosines allow."""
    p, step = min(probes, len(centres)), max(1, cells_at_once // len(centres))
    out = np.empty((len(rows), p), np.int32)
    for i in range(0, len(rows), step):
        far = -(unit(rows[i : i + step])[0] @ centres.T)
        some = np.sort(np.argpartition(far, p - 1, axis=1)[:, :p], axis=1)
        out[i : i + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return out


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """label (each row's smallest known partner) after rows x and y are linked pairwise; all pairs at once."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label[:] = up


def _compare(left: pa.Table, right: pa.Table, kind: str, cell: int, least: float, same: bool, tile: int = 512) -> pa.Table:
    """Links between two blocks of a cell: per row the sizes of its partners, and a forest over the ids of those linked.

    left may be homed elsewhere, right is at home. A pair that two cells see counts in that of the smaller number.
    """
    def matrix(t: pa.Table) -> np.ndarray:
        return unit(np.frombuffer(b"".join(t["raw"].to_pylist()), kind).reshape(t.num_rows, -1))[0]

    def column(t: pa.Table, c: str) -> np.ndarray:
        return t[c].to_numpy()

    a, b = matrix(left), matrix(right)
    at = np.concatenate((column(left, "at"), column(right, "at")))
    ids = np.concatenate((column(left, "id"), column(right, "id")))
    home_a, at_a, at_b = column(left, "home"), column(left, "at"), column(right, "at")
    size = np.concatenate((column(left, "size"), column(right, "size")))
    probes_b = right["probes"].combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1)
    n = np.zeros(len(at), np.int64)
    # rows in id order, so that the smallest row of a class has its smallest id
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    label = np.arange(len(ids))
    for i in range(0, len(a), tile):
        for j in range(0, len(b), tile):
            x, y = np.nonzero(a[i : i + tile] @ b[j : j + tile].T >= least)
            x, y = x + i, y + j
            at_home = home_a[x] == cell
            twice = ~at_home & (home_a[x] < cell) & (probes_b[y] == home_a[x][:, None]).any(axis=1)
            keep = ~twice & (~at_home | ~np.bool_(same) | (at_a[x] < at_b[y]))
            x, y = x[keep], y[keep] + len(a)
            np.add.at(n, x, size[y])
            np.add.at(n, y, size[x])
            _joined(label, place[x], place[y])
    some = n > 0
    low = ids[order][label[place]]
    return pa.table({"at": at[some], "id": ids[some], "n": n[some], "low": low[some]})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, rows_a_cell: int = 256, probes: int = 6, sample_rows: int = 32_768, most_cells: int = 4096, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links of cosine >= `least`, none below it.

    Rows of equal components are one vector to compare, told by a 128-bit digest: however many rows share it, it travels
    and is compared once, and stands for all of them; a row links with the others of its vector and with all rows of
    each vector that links with its own.

    Spherical k-means, fitted on at most sample_rows vectors, gives cells. Each vector lives in its nearest cell and
    is compared there with all that live there or have that cell among their `probes` nearest, so a pair is found
    unless each lives outside the other's probes. With probes of most_cells or more every pair is found: the exact
    setting. A cell is cut into blocks, and each pair of blocks is a task of its own, so a cell that holds a third of all
    vectors is spread out; a task sends one row per linked vector, its count and its smallest partner, never pairs.
    Components travel as they came (float or double) and are compared in double precision. The smallest vec_id of a
    component is kept.

    Null, empty and zero vectors, and those with a null or non-finite component, link with nothing. Vectors of
    different lengths do not compare. Each row is a vector: rows of a repeated vec_id have links of their own, to each
    other too, and share the component. A vec_id that is null has no link.
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"))
    good = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))
    valid = rows.where(good)
    cells = centroids(valid, rows_a_cell, sample_rows, most_cells)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, at, m in by_length(b.column(1), kind):
                near = nearest(m, shared.value.get(length, np.zeros((1, length))), probes)
                raw = [r.tobytes() for r in m]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                cols = [b.column(0).take(pa.array(at)), pa.array([length] * len(at), pa.int32()), pa.array(near[:, 0]), lists, pa.array(raw, pa.binary()), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "length", "home", "probes", "raw", "key"])

    placed = valid.mapInArrow(assign, "id long, length int, home int, probes array<int>, raw binary, key binary")
    every = written(placed.withColumn("at", F.monotonically_increasing_id()), "cells")  # the numbers hold from here on
    classes = every.groupBy("key").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("size"))
    classes = written(classes.select("key", F.col("first.id").alias("rep"), F.col("first.at").alias("at"), "size"), "vectors")
    placed = written(every.join(classes.select("at", "size"), "at"), "distinct-cells")
    # blocks of a cell: by hash, so many that each has about `block` rows, counted apart for who lives there and who looks in
    seen = placed.select("length", "home", F.explode("probes").alias("cell"))
    home = F.col("home") == F.col("cell")
    sizes = seen.groupBy("length", "cell").agg(F.ceil(F.sum(home.cast("long")) / block).cast("int").alias("homes"), F.ceil(F.sum((~home).cast("long")) / block).cast("int").alias("guests"))
    sizes = written(sizes.where("homes > 0"), "cell-blocks")
    # at most `most_cells` rows for each length of vectors
    looks = placed.withColumn("cell", F.explode("probes")).join(F.broadcast(sizes), ["length", "cell"])
    h = F.xxhash64("id", "at")
    own = F.pmod(h, F.col("homes")).cast("int")
    guest = F.pmod(h, F.col("guests")).cast("int") + F.col("homes")
    # home blocks i <= j meet each other; guest blocks meet each home block
    as_right = looks.where(home).withColumn("b", own)
    others = F.transform(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1), lambda o: F.struct(F.when((o < F.col("homes")) & (o <= F.col("b")), o).when(o >= F.col("homes"), o).alias("l"), F.col("b").alias("r"), F.lit(1).alias("side")))
    right = as_right.withColumn("t", F.explode(F.filter(others, lambda t: t["l"].isNotNull())))
    lefts = looks.withColumn("b", F.when(home, own).otherwise(guest))
    rights = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: F.struct(F.col("b").alias("l"), F.when(~home | (F.col("b") < o), o).alias("r"), F.lit(0).alias("side")))
    left = lefts.withColumn("t", F.explode(F.filter(rights, lambda t: t["r"].isNotNull())))
    cols = ["length", "cell", "t.l", "t.r", "t.side", "id", "at", "home", "size"]
    pairs = right.select(*cols, "probes", "raw").unionByName(left.select(*cols, F.array().cast("array<int>").alias("probes"), "raw"))

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        _, cell, l, r = (k.as_py() for k in key)
        is_right = part["side"].to_numpy() == 1
        right_side = part.filter(pa.array(is_right))
        same = l == r
        left_side = right_side if same else part.filter(pa.array(~is_right))
        if not right_side.num_rows or not left_side.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("at", "id", "n", "low")})
        return _compare(left_side, right_side, kind, cell, least, same)

    found = written(pairs.groupBy("length", "cell", "l", "r").applyInArrow(compare, "at long, id long, n long, low long"), "links")
    counts = found.groupBy("at").agg(F.sum("n").alias("n"))
    # a row of this join has about 40 bytes; adaptive execution splits a vector that very many rows share
    rows_of = every.select("id", "key").join(classes.join(counts, "at", "left"), "key")
    rows_of = written(rows_of.select("id", "rep", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n")), "members")
    linked = found.select("id", F.col("low").alias("rep")).unionByName(rows_of.select("id", "rep")).where("id <> rep")
    comp = components(linked, "id", "rep")
    out = rows_of.select("id", "n").unionByName(rows.where(~good).select("id", F.lit(0).cast("long").alias("n")))
    out = out.join(comp, F.col("id") == F.col("node"), "left")
    out = out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
