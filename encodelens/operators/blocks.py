"""Ordered folds of keys of any size: a key is cut into blocks of its order, and what a block does is put together from summaries.

A fold whose step depends on the one before it seems to need a key in one task. If the effect of a run of rows on any
state can be told in few words, blocks are summed up apart, the summaries of a key pass in order, and each block is then
folded from the state that it begins with: two parallel passes, and a short one in between.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: About as many rows of a key as one task folds.
ROWS_A_BLOCK = 1 << 18


def cuts(rows: DataFrame, order: str, rows_a_block: int = ROWS_A_BLOCK) -> list:
    """Values of `order` that cut all rows into equal parts of about rows_a_block, so no key has more rows in a part."""
    n = rows.count()
    parts = -(-n // rows_a_block)
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(order, shares, 100 * parts)).first()[0]
    return sorted(set(found or []))


def block_of(order: str | Column, bounds: list) -> Column:
    """The number of bounds that are not above `order`: equal values share a block, null ones have the first.

    The bounds, in ascending order, are searched by halving, so that a row does not meet each of them.
    """
    c = F.col(order) if isinstance(order, str) else order
    if not bounds:
        return F.lit(0)
    strides = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.lit(strides), F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & F.coalesce(F.get(F.lit(bounds), n + s - 1) <= c, F.lit(False)), n + s).otherwise(n))


def dealt(rows: DataFrame, *by: str, rows_a_task: int = ROWS_A_BLOCK) -> DataFrame:
    """rows by the hash of `by` in as many parts as hold about rows_a_task each; as they are, if one part does.

    Such a number stands, where adaptive execution would put parts together by their packed bytes, which say little of
    what a task then sorts and sums up.
    """
    parts = -(-rows.count() // rows_a_task)
    return rows.repartition(parts, *by) if parts > 1 else rows


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(first n values, rows) of each run of rows that are equal in them, as a stream."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    return groupby(rows, key=lambda r: r[:n])


def _packed(rows: Iterable[tuple], kind: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)


def fold_in_blocks(
    rows: DataFrame, key: str, order: list[str], schema: str, first: Any, step: Callable[[Any, tuple], tuple[Any, tuple | None]], effect: Callable[[Iterator[tuple]], Any], through: Callable[[Any, Any], Any],
    finish: Callable[[Any], tuple | None] | None = None, rows_a_block: int = ROWS_A_BLOCK,
) -> DataFrame:
    """What step gives for each row of a key in order, as if the key passed in one go, starting from the state `first`.

    step(state, row) -> (state, row of schema or None). effect(rows of a block) -> a small summary, and
    through(state, summary) -> the state after the block, which must be what step would reach. finish(state) gives a last
    row for a key. The first column of `order` is a number that cuts keys into blocks; rows that are equal in it share
    one. A key that holds any share of all rows is spread over as many tasks as it has blocks; one of up to rows_a_block
    rows is a block, whose start is known, so that only larger ones, of which there are few, are summed up. A null key is a key.
    """
    large = [k for (k,) in rows.groupBy(key).count().where(F.col("count") > rows_a_block).select(key).collect()]
    known = [k for k in large if k is not None]
    is_large = F.coalesce(F.col(key).isin(known), F.lit(None in large)) if large else F.lit(False)
    bounds = cuts(rows.where(is_large), order[0], rows_a_block) if large else []
    kind = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    cols = rows.columns
    blocks = rows.select(F.col(key).alias("_key"), F.when(is_large, block_of(order[0], bounds)).otherwise(0).alias("_block"), F.lit(None).cast("binary").alias("_state"), F.lit(False).alias("_last"), F.lit(1).alias("_kind"), *cols)
    if bounds:

        def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (k, b), some in _groups(batches, 2):
                yield pa.RecordBatch.from_arrays([pa.array([k], key_type), pa.array([b], pa.int32()), pa.array([pickle.dumps(effect(r[5:] for r in some))], pa.binary())], ["k", "b", "s"])

        def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (k,), some in _groups(batches, 1):
                state, before = first, None
                for _, b, s in some:
                    if before is not None:
                        yield start(k, before, False)
                    before = (b, pickle.dumps(state))
                    state = through(state, pickle.loads(s))
                if before is not None:
                    yield start(k, before, True)

        def start(k: Any, before: tuple, last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], key_type), pa.array([before[0]], pa.int32()), pa.array([before[1]], pa.binary()), pa.array([last])], ["_key", "_block", "_state", "_last"])

        key_type = to_arrow_schema(rows.select(key).schema).field(0).type
        name = rows.schema[key].dataType.simpleString()
        cut = blocks.where(is_large).repartition("_key", "_block").sortWithinPartitions("_key", "_block", *order)
        effects = cut.mapInArrow(sum_up, f"k {name}, b int, s binary")
        starts = effects.repartition("k").sortWithinPartitions("k", "b").mapInArrow(compose, f"_key {name}, _block int, _state binary, _last boolean")
        # a block's start is a row before its rows, so that both meet by one shuffle and no join
        heads = starts.select("_key", "_block", "_state", "_last", F.lit(0).alias("_kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        blocks = blocks.unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for _, some in _groups(batches, 2):
                state, last = first, True  # of a key that is cut, a head tells both
                for r in some:
                    if r[4] == 0:
                        state, last = pickle.loads(r[2]), r[3]
                        continue
                    state, given = step(state, r[5:])
                    if given is not None:
                        yield given
                if last and finish and (given := finish(state)) is not None:
                    yield given

        yield from _packed(out(), kind)

    return blocks.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_kind", *order).mapInArrow(run, schema)
