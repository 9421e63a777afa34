"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from encodelens.llm.common import broadcast_if_small, named, unpacked, whole_row, written

WORD = r"[^\x20\x09-\x0D]+"
#: The relative distance of a source's tokens from its target at which Newton steps end.
DONE = 1e-12


def word_counts(docs: DataFrame, text_col: str = "text", out: str = "size", keep_text: bool = False) -> DataFrame:
    """docs with the number of words (runs of anything but ASCII white space) of each whole text; 0 for null."""
    keep = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.fill_null(pc.count_substring_regex(b.column(b.num_columns - 1), WORD), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n.cast(pa.int64())], [*keep, out])

    schema = StructType([docs.schema[c] for c in keep]).add(out, "long")
    return docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(text_col).alias("_text")).mapInArrow(run, schema)


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """sources (source, source_size) with target: the tokens that each source is to give.

    Sources in code point order, null last, take the weights in turn and share all tokens. A target stops at `limit`
    times its source, and the excess is shared again by weight until none is above; that ends at
    target = min(limit * size, level * weight) with one level for all, found from running sums over the sources in
    the order in which they reach their limit. The table has one row per source.
    """
    order = [F.col("source").isNull(), F.col("source")]
    number = F.row_number().over(W.orderBy(*order)) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", given).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    reach = W.orderBy((F.col("most") / F.col("weight")).asc(), *order)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(reach.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(reach.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level_here", (F.sum("source_size").over(whole) - before) / left)
    # the first source that its own level does not fill sets the level; those before it stop at their limit
    s = s.withColumn("level", F.max(F.when(F.col("level_here") * F.col("weight") <= F.col("most"), F.col("level_here"))).over(whole))
    return s.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).drop("level_here", "level")


def _rate(tilt: Column, size: Column, limit: float) -> Column:
    """exp(tilt * size), stopped at limit before the exponential can overflow."""
    return F.when(tilt * size >= math.log(limit), F.lit(float(limit))).otherwise(F.exp(F.least(tilt * size, F.lit(math.log(limit)))))


def newton_step(counts: DataFrame, state: DataFrame, limit: float) -> DataFrame:
    """state (source, source_size, target, tilt, lo, hi, gap) after one Newton step of every source's dual.

    The gradient of the dual is the tokens that the rates give less the target; it and its slope are sums over the
    rows (source, size, n) of counts, one aggregation for all sources. The step is taken on the logarithm of the
    tokens, whose slope changes little; where it leaves the bracket [lo, hi] that the signs of the gradients so far
    leave, the bracket is halved instead. gap is the relative distance to the target before the step.
    """
    small, _ = broadcast_if_small(state, 200)
    x = counts.withColumnRenamed("source", "_s").join(small, F.col("source").eqNullSafe(F.col("_s")))
    words, free = F.col("n") * F.col("size") * _rate(F.col("tilt"), F.col("size"), limit), F.col("tilt") * F.col("size") < math.log(limit)
    s = x.groupBy("source", "source_size", "target", "tilt", "lo", "hi").agg(F.sum(words).alias("_words"), F.sum(F.when(free, words * F.col("size")).otherwise(0.0)).alias("_slope"))
    over = F.col("_words") > F.col("target")
    s = s.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("tilt"))).withColumn("hi", F.when(over, F.col("tilt")).otherwise(F.col("hi")))
    s = s.withColumn("gap", F.abs(F.col("_words") - F.col("target")) / F.col("target"))
    to = F.col("tilt") - F.log(F.col("_words") / F.col("target")) * F.col("_words") / F.col("_slope")
    good = (F.col("_slope") > 0) & (to > F.col("lo")) & (to < F.col("hi"))
    tilt = F.when(F.col("gap") <= DONE, F.col("tilt")).when(good, to).otherwise((F.col("lo") + F.col("hi")) / 2)
    return s.withColumn("tilt", tilt).select(*state.columns)


def tilts(counts: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: float = 3.0, at_once: int = 4, most: int = 60) -> DataFrame:
    """(source, source_size, target, tilt): the solution of the convex dual for the token constraint of each source.

    Entropy balancing: of all rates between 0 and limit that give the source its target in tokens, those nearest to 1 in
    relative entropy are exp(tilt * size), stopped at limit. counts: (source, size, n). The root lies
    between minus log(source_size / target) and log(limit), as sizes other than 0 are 1 at least. Newton steps go on, `at_once` of
    them a job, until every source's gap is 1e-12; the driver sees the largest gap alone. Sources whose target is 0 or all
    they have at the limit need no step.
    """
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    state = targets(sizes, weights, limit).where("source_size > 0")
    least = F.log(F.col("source_size") / F.greatest("target", F.lit(1e-9)))
    state = state.select("source", "source_size", "target", F.lit(0.0).alias("tilt"), (-F.greatest(least, F.lit(0.0)) - 1e-9).alias("lo"), F.lit(math.log(limit) + 1e-9).alias("hi"), F.lit(1.0).alias("gap"))
    full = F.col("target") >= F.col("source_size") * (limit * (1 - 1e-12))
    state = written(state.withColumn("tilt", F.when(full, F.col("hi")).otherwise(F.col("tilt"))).withColumn("gap", F.when(full, F.lit(0.0)).otherwise(F.lit(1.0))).coalesce(1), "tilts")
    for _ in range(0, most, at_once):
        if state.where(F.col("gap") > DONE).isEmpty():
            break
        done, left = state.where(F.col("gap") <= DONE), state.where(F.col("gap") > DONE)
        for _ in range(at_once):
            left = newton_step(counts, left, limit)
        state = written(done.unionByName(left).coalesce(1), "tilts")
    return state.select("source", "source_size", "target", "tilt")


def _ranked(d: DataFrame, limit: float) -> DataFrame:
    """d (id, size, _tilt) with _whole, copies for sure, and _v, the order in which documents get one more.

    _v is a hash of id and size, in [0, 1), less the fraction that the rate leaves: at 0 each document has one more with
    the chance of its fraction. Documents of size 0 keep one copy, and those at the limit have all: _v is null.
    """
    rate = _rate(F.col("_tilt"), F.col("_size"), limit)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.col("_size").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    d = d.withColumn("_rate", F.when(F.col("_size") == 0, F.lit(1.0)).otherwise(F.coalesce(rate, F.lit(0.0))))
    d = d.withColumn("_whole", F.floor("_rate").cast("long"))
    return d.withColumn("_v", F.when((F.col("_size") > 0) & (F.col("_whole") < int(limit)), u - (F.col("_rate") - F.col("_whole"))))


def _with_plan(d: DataFrame, plan: DataFrame) -> DataFrame:
    per, _ = broadcast_if_small(plan, 200)
    return d.join(per, d["_source"].eqNullSafe(per["_plan_source"]), "left").drop("_plan_source")


def _plan(slim: DataFrame, weights: Sequence[float], limit: float, buckets: int | None) -> DataFrame:
    """A row per source: its size, target, tilt, and the last (_v, id, size) that gets one more copy, in _cut."""
    counts = written(slim.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "size-counts")
    solved = tilts(counts, weights, limit)
    solved = written(solved.select(F.col("source").alias("_plan_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("tilt").alias("_tilt")), "source-tilts")
    rows = _ranked(_with_plan(slim.where("_size > 0"), solved), limit)
    # the bucket in which a source's words meet its target, from sums per bucket of _v, each with about 4,096 rows
    buckets = buckets or 1 << max(12, (slim.count() >> 12).bit_length())
    rows = rows.withColumn("_bucket", F.least(F.floor((F.col("_v") + 1) * (buckets // 2)), F.lit(buckets - 1)).cast("int"))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum(F.col("_whole") * F.col("_size")).alias("sure"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_size")).otherwise(0)).alias("words"))
    sums = written(sums, "bucket-words")
    by, upto = W.partitionBy("_source"), W.partitionBy("_source").orderBy(F.col("_bucket").asc_nulls_first())
    b = sums.withColumn("sure", F.sum("sure").over(by)).withColumn("before", F.sum("words").over(upto) - F.col("words")).where("_bucket is not null")
    b = b.select(F.col("_source").alias("source"), F.col("_bucket").alias("bucket"), "sure", "before", "words")
    b = _with_plan(b.withColumnRenamed("source", "_source"), solved.select("_plan_source", "_target")).withColumn("extra", F.col("_target") - F.col("sure"))
    # the first bucket whose words reach the extra, or the last bucket of all
    cut = b.groupBy("_source").agg(F.min(F.when(F.col("before") + F.col("words") >= F.col("extra"), F.struct("bucket", "before", "extra"))).alias("c"), F.max(F.struct("bucket", "before", "extra")).alias("last"))
    cut = cut.select(F.col("_source").alias("_plan_source"), F.coalesce("c", "last").alias("c"))
    cut = cut.select("_plan_source", F.col("c.bucket").alias("_at"), F.col("c.before").alias("_before"), F.col("c.extra").alias("_extra"))
    cut = written(cut, "cut-buckets")
    here = _with_plan(rows.where("_v is not null"), cut).where("_bucket = _at")
    order = W.partitionBy("_source").orderBy("_v", "_id", "_size")
    here = here.withColumn("_gap", F.abs(F.col("_before") + F.sum("_size").over(order) - F.col("_extra")))
    ends = here.groupBy("_source").agg(F.min(F.struct("_gap", "_v", "_id", F.col("_size"))).alias("best"), F.first(F.abs(F.col("_before") - F.col("_extra"))).alias("none"))
    ends = ends.select(F.col("_source").alias("_s"), F.when(F.col("best._gap") < F.col("none"), F.struct("best._v", "best._id", "best._size")).alias("_cut"))
    plan = solved.join(cut.select(F.col("_plan_source").alias("_c"), "_at"), F.col("_plan_source").eqNullSafe(F.col("_c")), "left").drop("_c")
    plan = plan.join(ends, F.col("_plan_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # below the bucket all documents have one more; _low stands for "none in it"
    return written(plan.withColumn("_low", F.col("_at") / F.lit(buckets // 2) - 1).drop("_at"), "source-cuts")


def _copies(d: DataFrame, plan: DataFrame, limit: float) -> DataFrame:
    """d (_id, _source, _size and others) with the plan's columns and _copies; nothing is shuffled but by a large plan."""
    d = _ranked(_with_plan(d, plan), limit)
    more = F.coalesce(F.struct("_v", "_id", "_size") <= F.col("_cut"), F.col("_v") < F.col("_low"), F.lit(False)) & F.col("_v").isNotNull()
    return d.withColumn("_copies", F.col("_whole") + more.cast("long"))


def mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: Sequence[float] = (1, 2, 3), limit: float = 3.0, buckets: int | None = None) -> DataFrame:
    """(id, source, size) with source_size, target, rate and copies.

    Entropy balancing (tilts()) gives each document the rate exp(tilt of its source * size), at most `limit`. A rate is
    rounded into copies: the whole part for sure, and one more for the documents that come first by hash less fraction,
    as many as bring the source nearest to its target. They are found from sums per bucket of that order, and only
    the bucket in which the target is met is sorted, so a hot source is not; a source misses its target by half a
    document or so. Null and empty texts have size 0 and one copy; rows alike in id and size take equal copies; null
    sources form a source of their own; a source without words has target 0. Other columns are ignored. Reruns agree.
    """
    slim = written(sized.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(size_col).cast("long").alias("_size")), "sizes")
    out = _copies(slim, _plan(slim, weights, limit, buckets), limit)
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias(size_col), F.coalesce("_source_size", F.lit(0)).alias("source_size"), F.coalesce("_target", F.lit(0.0)).alias("target"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (1, 2, 3), limit: float = 3.0, buckets: int | None = None) -> DataFrame:
    """The mixed documents: each row with all its columns, as often as its copies say (0: not at all).

    Rows are treated as by mix(); columns of docs may have any names. The texts are read twice and never shuffled.
    """
    slim = word_counts(docs.select(named(id_col).alias("_id"), named(source_col).alias("_source"), named(text_col).alias("_text")), "_text", "_size")
    slim = written(slim, "sizes")
    plan = _plan(slim, weights, limit, buckets)
    rows = docs.select(whole_row(docs).alias("_row"), named(id_col).alias("_id"), named(source_col).alias("_source"), named(text_col).alias("_text"))
    rows = rows.withColumn("_size", F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long")).drop("_text")
    out = _copies(rows, plan, limit).where("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*unpacked("_row", docs.columns))
