"""Folds over the rows of a key in order, where what a row gives depends on what those before it gave."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def fold_in_order(rows: DataFrame, key: str, order: list[str], schema: str, step: Callable[[Any, tuple], tuple[Any, tuple | None]]) -> DataFrame:
    """What step gives for each row of a key in order: (state, row) -> (state, row of schema or None); the first state is None.

    Rows are dealt by key and sorted by Spark, which spills, and pass as a stream with one state held, so a key may have
    any number of rows. A null key is a key.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    at = rows.columns.index(key)
    kind = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[at] != now:
                    now, state = row[at], None
                state, given = step(state, row)
                if given is not None:
                    out.append(given)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(kind), kind)], schema=kind)

    return dealt.mapInArrow(run, schema)
