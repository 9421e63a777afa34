"""What the operators of this subpackage share: tables, the shared scratch folder, written tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; sf_dir may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches that end by their bytes, as one text can hold many MB; a session that has set them keeps its own."""
    if spark.conf.get(BATCH, None) in (None, "-1"):
        spark.conf.set(BATCH, size)


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_scratch[0]


_passing: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that written() makes inside are deleted at the end, but for those taken out of the list: what is read from them must be written by then."""
    _passing.append([])
    try:
        yield _passing[-1]
    finally:
        for df in _passing.pop():
            drop_written(df)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _passing:
        _passing[-1].append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    spark, path = df.sparkSession, getattr(df, "_written_to", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task as (node, smallest node that it is connected to in this task), but for those nodes."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    n = sum(len(u) for u, _ in got)
    nodes, at = np.unique(np.concatenate([x for pair in zip(*got) for x in pair]), return_inverse=True)
    a, b = at[:n], at[n:]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    far = np.flatnonzero(label != np.arange(len(nodes)))
    for i in range(0, len(far), 1 << 16):
        some = far[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], ["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.isEmpty() and edges.join(edges.select(F.col("u").alias("_u")), F.col("v") == F.col("_u"), "left_semi").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", edges_a_task: int = 1 << 19) -> DataFrame:
    """(node, component) of each node of the edges: the smallest node that it is connected to.

    Each round every task replaces the edges it holds, edges_a_task or so, by a forest; then a large-star and a
    small-star step carry the smallest nodes across tasks, so the number of edges falls and the number of rounds follows
    the logarithm of the longest path. Once one task holds all that is left, its forest is the answer. Edges stay in
    written tables; the driver sees a count a round. Null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null and u > v")
    e = written(e.distinct(), "edges")
    while (n := e.count()) > edges_a_task:
        f = e.coalesce(-(-n // edges_a_task)).mapInArrow(_forest, "u long, v long")
        both = written(f.unionByName(f.select(F.col("v").alias("u"), F.col("u").alias("v"))), "forest")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node and its own minimum stay linked: u - m comes from the row whose v is m
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = written(small.where("u > v").distinct(), "edges")
        drop_written(e)
        drop_written(both)
        e = nxt
        if _stars(e):
            break
    else:
        e = written(e.coalesce(1).mapInArrow(_forest, "u long, v long"), "forest")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select("v", "v").toDF("node", "component").distinct())


def named(c: str) -> Column:
    """The column of exactly this name, whatever signs the name holds."""
    return F.col("`" + c.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [named(c) for c in df.columns]


def whole_row(df: DataFrame) -> Column:
    """The columns of df as one struct; unpacked() takes it apart again."""
    return F.struct(*[named(c).alias(c) for c in df.columns])


def unpacked(row: str, names: list[str]) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in names]


def broadcast_if_small(df: DataFrame, bytes_a_row: int, limit: int = 64 << 20) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its rows, counted, take no more than limit bytes; else df for a shuffled join."""
    small = df.count() * bytes_a_row <= limit
    return (F.broadcast(df) if small else df), small


def utf8(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("binary")
