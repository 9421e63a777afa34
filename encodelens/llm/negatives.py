"""Hard negatives: per anchor and positive, the most similar rows of other labels within a window below the positive."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.llm.common import written
from encodelens.llm.products import NONE, best_in_rounds, found, matrix, order_keys, usable
from encodelens.llm.residues import Residues, product


def best_in_windows(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, out: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of scores, window, score, column) of the k greatest scores in each window low..high of each row, ties to the smaller id.

    out marks the scores that do not count. A window with low > high holds nothing.
    """
    parts = []
    if (keyed := order_keys(scores, ids, at)) is not None:
        keys, order = keyed
        bits = max(1, int(len(ids) - 1).bit_length())
        rank = (1 << bits) - 1
        keys = np.sort(np.where(out, NONE, keys), axis=1)
        for i in range(len(keys)):
            row = keys[i, np.searchsorted(keys[i], NONE, side="right") :]
            if not len(row):
                continue
            value = row >> bits
            ends, starts = np.searchsorted(value, highs[i], side="right"), np.searchsorted(value, lows[i], side="left")
            for w, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
                best = row[max(start, end - k) : end]
                if len(best):
                    parts.append((np.full(len(best), i), np.full(len(best), w), best >> bits, order[rank - (best & rank)]))
    else:
        for i in range(len(scores)):
            by = np.lexsort((at, ids, -scores[i]))
            by = by[~out[i][by]]
            for w in range(lows.shape[1]):
                best = by[(scores[i][by] >= lows[i, w]) & (scores[i][by] <= highs[i, w])][:k]
                if len(best):
                    parts.append((np.full(len(best), i), np.full(len(best), w), scores[i][best], best))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[return-value]
    return tuple(np.concatenate(c) for c in zip(*parts))  # type: ignore[return-value]


def percent(score: np.ndarray, pct: int, up: bool) -> np.ndarray:
    """pct percent of whole numbers, rounded down or up, without a number beyond a long on the way."""
    q, r = np.divmod(score, 100)
    return q * pct + (-(-r * pct // 100) if up else r * pct // 100)


def _shard(scale: int, k: int, same_label: bool, low_pct: int, high_pct: int) -> Callable[[pa.Table], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def shard(held: pa.Table) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        ids, at, label = (held[c].to_numpy() for c in ("id", "at", "label"))
        rows = Residues(matrix(held, scale))

        def search(part: pa.RecordBatch) -> pa.RecordBatch:
            query = part.column("at").to_numpy()
            scores = product(Residues(matrix(part, scale)), rows)
            bounds = part.column("bounds").flatten().to_numpy().reshape(len(query), -1)
            equal = label == part.column("label").to_numpy()[:, None]
            if same_label:
                out, lows, highs = ~equal | (at == query[:, None]), bounds, np.full_like(bounds, 2**63 - 1)
            else:
                positives = part.column("positives")
                n = np.diff(positives.offsets.to_numpy())
                highs, lows = np.full_like(bounds, NONE), np.full_like(bounds, 2**63 - 1)
                has = np.arange(bounds.shape[1]) < n[:, None]
                got = positives.flatten().to_numpy()
                highs[has], lows[has] = percent(got, high_pct, False), percent(got, low_pct, True)
                out, lows = equal, np.maximum(lows, bounds)
            q, slot, score, col = best_in_windows(scores, ids, at, out, lows, highs, k)
            return found(query[q], slot, score, ids[col], at[col])

        return search

    return shard


def hard_negatives(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low_pct: int = 30, high_pct: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, rows_a_shard: int = 4096, block: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    Components become floor(scale * x); a row's score is its exact inner product with the anchor, multiplied modulo
    small primes in float32 and put together by Chinese remainders. An anchor's positives are its n_positives best
    other rows of its label, ties to the smaller id; a positive's negatives are the first n_negatives rows of other
    labels whose score is low_pct to high_pct percent of the positive's, both ends included. `anchors` is a condition on
    the id column, named `id`.

    Rows of a label, and all rows, are dealt by hash to shards of about rows_a_shard; anchors stream past in blocks,
    and the kth score of each window found so far goes with them from round to round. Rows with a null id, label or
    vector, or a null or non-finite component, take no part. Vectors of different lengths do not compare. Each row
    counts on its own, also with a repeated id: a row is never its own positive, its copies of the same label may be.
    A window without rows gives none; with a positive score below 0 it is empty. Scores of 2 ** 62 or more in absolute
    value raise OverflowError. Other columns play no part; empty tables give an empty result.
    """
    rows = usable(vectors, id_col, vec_col, label_col).withColumnRenamed(label_col, "label")
    asked = rows.where(anchors)
    positives = best_in_rounds(rows, asked, ["length", "label"], _shard(scale, n_positives, True, low_pct, high_pct), n_positives, 1, rows_a_shard, block)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    positives = written(positives.select("query", "id", "score", (rank - 1).cast("int").alias("slot")), "positives")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda p: p["score"])
    windows = asked.join(positives.groupBy(F.col("query").alias("at")).agg(in_order.alias("positives")), "at")
    got = best_in_rounds(rows, windows, ["length"], _shard(scale, n_negatives, False, low_pct, high_pct), n_negatives, n_positives, rows_a_shard, block)
    rank = F.row_number().over(W.partitionBy("query", "slot").orderBy(F.desc("score"), "id", "row"))
    got = got.select("query", "slot", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("query", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    of = asked.select(F.col("at").alias("query"), F.col("id").alias("anchor_id"))
    return got.join(named, ["query", "slot"]).join(of, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
