"""The k rows of greatest inner product with each query: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.llm.products import NONE, best_in_rounds, found, matrix, usable
from encodelens.llm.residues import Residues, norms, product


class BallTree:
    """Balls (center, radius) over rows: a node's rows are a run of `order`, its children split it in halves.

    A split follows the line between two far rows. A ball of radius 0, of equal rows, is not split.
    """

    def __init__(self, rows: np.ndarray, leaf: int = 64):
        self.order = np.arange(len(rows))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centers, radii = [], []
        waiting = [(0, len(rows), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            these = rows[self.order[start:end]]
            center = these.mean(axis=0)
            far = norms(these - center)
            node = len(self.spans)
            self.spans.append((start, end))
            self.children.append(None)
            centers.append(center)
            radii.append(float(far.max()))
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)  # type: ignore[assignment]
            if end - start > leaf and radii[-1] > 0:
                a = these[far.argmax()]
                b = these[norms(these - a).argmax()]
                middle = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(these @ (b - a), middle)]
                waiting += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def bounds(self, queries: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Per query and node a number that no inner product with a row of the node exceeds, rounding included."""
        reach = norms(self.centers) + self.radii
        return queries @ self.centers.T + size[:, None] * (self.radii + 1e-12 * reach) + 1e-6


class Searcher:
    """A shard's tree and the search of blocks of queries in it; `visited` counts rows scored, `asked` those there were."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int, leaf: int = 64):
        self.rows, self.ids, self.at, self.k = rows, ids, at, k
        self.tree, self.size = BallTree(rows, leaf), norms(rows)
        self.place = np.empty(len(ids), np.int64)
        self.place[np.lexsort((at, ids))] = np.arange(len(ids))
        self.by_place = np.argsort(self.place)
        self.visited = self.asked = 0

    def _scores(self, queries: np.ndarray, these: np.ndarray) -> np.ndarray:
        """Exact: doubles where every partial sum is a whole number below 2 ** 53, residues beyond."""
        part = self.rows[these]
        if float(norms(queries).max(initial=0)) * float(self.size[these].max(initial=0)) < 2.0**52:
            return (queries @ part.T).astype(np.int64)
        return product(Residues(queries), Residues(part))

    def search(self, queries: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row in the block, score, row of the shard) of the k best rows of each query among those not below `least`.

        The node with the greatest bound for any query goes first; a query goes into a node only if the node's bound
        reaches its kth score so far, which starts from the one that other shards have given. Rows that tie with it are
        looked at, as a smaller id may win.
        """
        m, k = len(queries), self.k
        size = norms(queries)
        upper = self.tree.bounds(queries, size)
        score = np.full((m, k), NONE, np.int64)
        place = np.full((m, k), len(self.rows), np.int64)
        kth = np.where(least == NONE, -np.inf, least.astype(np.float64))
        kth = np.where(np.abs(kth) >= 2.0**53, np.nextafter(kth, -np.inf), kth)
        heap = [(-float(upper[:, 0].max(initial=-np.inf)), 0)]
        self.asked += m * len(self.rows)
        while heap:
            _, node = heapq.heappop(heap)
            go = np.flatnonzero(upper[:, node] >= kth)
            if not len(go):
                continue
            children = self.tree.children[node]
            if children:
                for c in children:
                    top = upper[go, c]
                    top = top[top >= kth[go]]
                    if len(top):
                        heapq.heappush(heap, (-float(top.max()), c))
                continue
            start, end = self.tree.spans[node]
            these = self.tree.order[start:end]
            self.visited += len(go) * len(these)
            new = self._scores(queries[go], these)
            places = np.broadcast_to(self.place[these], new.shape)
            own = self.at[these] == at[go][:, None]
            both = np.concatenate((score[go], np.where(own, NONE, new)), axis=1)
            order = np.concatenate((place[go], np.where(own, len(self.rows), places)), axis=1)
            best = np.lexsort((order, -both), axis=1)[:, :k] if both.size else np.zeros((len(go), 0), np.int64)
            score[go], place[go] = np.take_along_axis(both, best, 1), np.take_along_axis(order, best, 1)
            last = score[go, -1]
            kth[go] = np.maximum(kth[go], np.where(place[go, -1] < len(self.rows), np.nextafter(last.astype(np.float64), -np.inf), -np.inf))
        q, j = np.nonzero((place < len(self.rows)) & (score >= least[:, None]))
        return q, score[q, j], self.by_place[place[q, j]]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, rows_a_shard: int = 4096, leaf: int = 64, block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): per row for which `queries` holds, the k other rows of greatest inner product.

    Components become floor(scale * x); scores are exact. Ties go to the smaller id. Rows are dealt by hash to shards of
    about rows_a_shard, each with a ball tree; queries stream past in blocks. After the first shard and after every
    round a query's kth score goes with it to the next shards, so their trees are cut from the start. `queries` is a
    condition on the id column, named `id`.

    Rows with a null id, a null vector or a null or non-finite component take no part. Vectors of different lengths do
    not compare; empty ones score 0. Each row is a vector: rows of a repeated id are found, and ask, on their own. A
    query with fewer than k others gets all. Scores of 2 ** 62 or more in absolute value raise OverflowError. Other
    columns play no part. No rows or no queries give an empty result.
    """
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(queries)

    def shard(held: pa.Table) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        ids, at = held["id"].to_numpy(), held["at"].to_numpy()
        searcher = Searcher(matrix(held, scale), ids, at, k, leaf)

        def search(part: pa.RecordBatch) -> pa.RecordBatch:
            query = part.column("at").to_numpy()
            q, score, row = searcher.search(matrix(part, scale), query, part.column("bounds").flatten().to_numpy())
            return found(query[q], np.zeros(len(q), np.int32), score, ids[row], at[row])

        return search

    best = best_in_rounds(rows, asked, ["length"], shard, k, 1, rows_a_shard, block)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    names = asked.select(F.col("at").alias("query"), F.col("id").alias("query_id"))
    return best.withColumn("rank", rank).join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
