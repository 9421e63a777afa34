"""Exact order statistics of large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_marks(df: DataFrame, key: str, value: str, shares: dict[str, float], extra: dict[str, Column] | None = None, buckets: int = 4096) -> DataFrame:
    """(key, n, one column per name of shares): the value at index min(n - 1, floor(share * n)) of a key's sorted values.

    Values fall into equal-width buckets between their key's extremes; running counts over the buckets tell in which
    one each index lies, and only those buckets' rows are ranked. Null values do not count. `extra` are further
    aggregates of the same rows, which need no scan of their own.
    """
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (extra or {}).items()])
    v = known.select(key, F.col(value).alias("_v"))
    wide = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    v = v.join(ends.select(key, "_lo", "_hi", "n"), key).withColumn("_b", F.least(F.floor((F.col("_v") - F.col("_lo")) / wide * buckets), F.lit(buckets - 1)).cast("int"))
    counts = v.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"))
    counts = counts.withColumn("_to", F.sum("_c").over(W.partitionBy(key).orderBy("_b"))).withColumn("_from", F.col("_to") - F.col("_c"))
    at = {name: F.least(F.col("n") - 1, F.floor(F.col("n") * share)) for name, share in shares.items()}
    inside = [(i >= F.col("_from")) & (i < F.col("_to")) for i in at.values()]
    some = inside[0]
    for x in inside[1:]:
        some = some | x
    few = v.drop("n", "_lo", "_hi").join(counts.where(some).select(key, "_b", "_from", "n"), [key, "_b"])
    rank = F.row_number().over(W.partitionBy(key, "_b").orderBy("_v")) - 1 + F.col("_from")
    few = few.withColumn("_i", rank)
    marks = few.groupBy(key).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(name) for name, i in at.items()])
    return ends.drop("_lo", "_hi").join(marks, key)
