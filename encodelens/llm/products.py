"""Inner products of whole-number vectors: rows in shards, queries that stream past them, bounds shared from round to round."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.llm.common import broadcast_if_small, drop_written, named, small_batches, written

#: The bound of a slot that has not found all its rows yet.
NONE = -(2**63 - 1)
#: A row that something found: the query's row and slot, and the row found with its score.
FOUND = "query long, slot int, score long, id long, row long"


def usable(vectors: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(at, id, length, vec, *more) of the rows that can be compared, in a written table in which `at` numbers each row.

    Rows with a null id, a null vector, a null or non-finite component, or a null in `more` take no part. Components
    stay as they came, float or else double.
    """
    small_batches(vectors.sparkSession)
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vec_col).cast(f"array<{kind}>").alias("vec"), *[named(c).cast("long").alias(c) for c in more])
    whole = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    for c in more:
        whole = whole & named(c).isNotNull()
    rows = rows.where(F.coalesce(whole, F.lit(False))).withColumn("length", F.size("vec").cast("long"))
    return written(rows.withColumn("at", F.monotonically_increasing_id()), "vectors")


def sharded(rows: DataFrame, on: list[str], rows_a_shard: int) -> tuple[DataFrame, DataFrame, int, int]:
    """rows with their shard within their group of `on`, the groups' numbers of shards, and their greatest and their sum.

    A shard has about rows_a_shard rows of one group, dealt by hash, so a group that holds a third of all rows is many.
    """
    sizes = written(rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows_a_shard).cast("int").alias("shards")), "shards")
    most, total = sizes.agg(F.max("shards"), F.sum("shards")).first()
    small, _ = broadcast_if_small(sizes, 100)
    return rows.join(small, on).withColumn("shard", F.pmod(F.xxhash64("at"), F.col("shards")).cast("long")).drop("shards"), small, most or 0, total or 0


def matrix(part: pa.RecordBatch | pa.Table, scale: int) -> np.ndarray:
    """The vectors of rows of one length, as floor(scale * x) in double precision."""
    lists = part.column("vec")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.floor(scale * lists.flatten().to_numpy().astype(np.float64)).reshape(part.num_rows, int(part.column("length")[0].as_py()))


def _stream(rows: DataFrame, queries: DataFrame, on: list[str], tasks: int, shard: Callable[[pa.Table], Callable[[pa.RecordBatch], pa.RecordBatch]], block: int) -> DataFrame:
    """What shard(rows of a shard)(queries) finds, `block` queries at a time.

    Each shard's rows come first in their partition and are held; its queries stream past them, however many they are.
    """
    both = rows.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.select(*on, "kind", *[c for c in both.columns if c not in (*on, "kind")])
    dealt = both.repartition(tasks, *on).sortWithinPartitions(*on, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, search = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(len(on) + 1)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                group, part = keys[:-1, start].tolist(), b.slice(start, end - start)
                if group != now:
                    now, held, search = group, [], None
                if keys[-1, start] == 0:
                    held.append(part)
                elif held or search:
                    if not search:
                        search, held = shard(pa.Table.from_batches(held)), []
                    for i in range(0, part.num_rows, block):
                        got = search(part.slice(i, block))
                        if got.num_rows:
                            yield got

    return dealt.mapInArrow(run, FOUND)


def found(query: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(slot, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int64())], ["query", "slot", "score", "id", "row"])


def best_in_rounds(rows: DataFrame, queries: DataFrame, on: list[str], shard: Callable[[pa.Table], Callable[[pa.RecordBatch], pa.RecordBatch]], k: int, slots: int, rows_a_shard: int, block: int, growth: int = 8) -> DataFrame:
    """FOUND: per query and slot the k rows of greatest score, ties to the smaller id.

    A query visits the shards of its group in an order of its own, in rounds of 1, 8, 64 ... shards; before a round
    each of its slots that has k rows gets the score of the last as `bounds`, below which nothing need be looked at.
    """
    rows, sizes, most, total = sharded(rows, on, rows_a_shard)
    queries = written(queries.join(sizes, on), "queries")
    best, done, step = None, 0, 1
    while done < most or best is None:
        to = min(done + step, most)
        asked = queries
        if best is None:
            asked = asked.withColumn("bounds", F.array(*[F.lit(NONE)] * slots))
        else:
            last = best.groupBy("query").pivot("slot", list(range(slots))).agg(F.when(F.count(F.lit(1)) == k, F.min("score")))
            last = last.select(F.col("query").alias("at"), F.array(*[F.coalesce(F.col(f"`{s}`"), F.lit(NONE)) for s in range(slots)]).alias("bounds"))
            asked = asked.join(last, "at", "left").withColumn("bounds", F.coalesce("bounds", F.array(*[F.lit(NONE)] * slots)))
        asked = asked.where(F.col("shards") > done)
        turn = F.explode(F.sequence(F.lit(done), F.least(F.lit(max(to, done + 1)), F.col("shards")) - 1))
        asked = asked.withColumn("turn", turn).withColumn("shard", F.pmod(F.xxhash64("at", F.lit(1)) % (1 << 40) + F.col("turn"), F.col("shards")).cast("long")).drop("turn", "shards")
        new = _stream(rows, asked, [*on, "shard"], max(1, 2 * total), shard, block)
        rank = F.row_number().over(W.partitionBy("query", "slot").orderBy(F.desc("score"), "id", "row"))
        merged = written((new if best is None else new.unionByName(best)).withColumn("_n", rank).where(F.col("_n") <= k).drop("_n"), "best")
        if best is not None:
            drop_written(best)
        best, done, step = merged, max(to, 1), step * growth
    drop_written(queries)
    return best


def order_keys(scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers that sort as (score, then smaller id) do, with the rows in the order of which a key's low bits tell; None if a score is too large."""
    n = len(ids)
    bits = max(1, int(n - 1).bit_length())
    if scores.size and max(int(scores.max()), -int(scores.min())) >= 1 << (62 - bits):
        return None
    order = np.lexsort((at, ids))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return (scores << bits) | ((1 << bits) - 1 - place), order
