"""Per-frame score series: pulse, trend, autocorrelation, folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def detrend(frames: DataFrame, window: int, block: int = 1_000_000) -> DataFrame:
    """frames with residual: the score less the mean of `window` frames around it, cut off at the ends.

    A window under 3 frames, or as long as the series, takes the series' mean instead. A long series is worked in blocks
    of frames that carry half a window of their neighbours, so that none needs one task.
    """
    n = frames.groupBy("series").agg(F.count(F.lit(1)).alias("_n"), F.avg("score").alias("_mean"))
    h = window // 2
    # frames within half a window of a block's edge go to the neighbouring block too, as context
    b = F.floor(F.col("frame") / block)
    near = F.array_distinct(F.array(b, F.floor((F.col("frame") - h) / block), F.floor((F.col("frame") + h) / block)))
    f = frames.withColumn("_own", b).withColumn("_block", F.explode(near))
    by = W.partitionBy("series", "_block").orderBy("frame").rowsBetween(-h, h)
    f = f.withColumn("_local", F.avg("score").over(by)).where("_own = _block").join(n, "series")
    mean = F.when((F.lit(window) < 3) | (F.col("_n") <= window), F.col("_mean")).otherwise(F.col("_local"))
    return f.withColumn("residual", F.col("score") - mean).select(*frames.columns, "residual")


def autocorrelation(residuals: DataFrame, max_lag: int, value: str = "residual", block: int = 1024) -> DataFrame:
    """(series, lag, r) for lags 0 to max_lag, over the sum of squared deviations; a constant series gives zeros.

    A series is cut into blocks, each with the max_lag frames behind it; a block multiplies itself by its shifts as
    arrays, and the sums meet per lag. So a frame is sent twice at most, whatever the lags, and a long series is shared by
    tasks. Missing frames count 0.
    """
    d, den = _deviations(residuals, value)
    return _correlated(_products(d, ["series"], max_lag, block), den, ["series"])


def _deviations(residuals: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Frames of a series with d, their distance from its mean, and per series den, the sum of its squares, and n.

    Tables of a row a series grow with the input, so they meet others by shuffle and none is sent through the driver.
    """
    mean = residuals.groupBy("series").agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("n"))
    d = residuals.join(mean.hint("merge"), "series").select("series", "frame", (F.col(value) - F.col("_m")).alias("d"), "n")
    return d.drop("n"), d.groupBy("series").agg(F.sum(F.col("d") * F.col("d")).alias("den"), F.first("n").alias("n"))


def _products(d: DataFrame, keys: list[str], max_lag: int, block: int) -> DataFrame:
    """(keys, lag, s): the sums of products of deviations that are lag frames apart, of d (keys, frame, d)."""
    size = max(block, max_lag + 1)
    own = F.floor(F.col("frame") / size)
    d = d.select(*keys, "frame", "d", F.explode(F.when(F.col("frame") - own * size < max_lag, F.array(own - 1, own)).otherwise(F.array(own))).alias("at"))
    # a frame stands for itself and, with 0, for those missing behind it
    gap = F.lead("frame").over(W.partitionBy(*keys, "at").orderBy("frame")) - F.col("frame") - 1
    zeros = F.array_repeat(F.lit(0.0), F.coalesce(gap, F.lit(0)).cast("int"))
    d = d.withColumn("x", F.concat(F.array("d"), zeros)).withColumn("mine", F.when(F.floor(F.col("frame") / size) == F.col("at"), F.least(F.size("x"), ((F.col("at") + 1) * size - F.col("frame")).cast("int"))).otherwise(0))
    b = d.groupBy(*keys, "at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda r: r["x"])).alias("x"), F.sum("mine").cast("int").alias("own")).where("own > 0")

    def shifted(lag: Column) -> Column:
        products = F.zip_with(F.slice("x", 1, F.col("own")), F.slice("x", lag + 1, F.col("own")), lambda a, c: a * F.coalesce(c, F.lit(0.0)))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + F.coalesce(p, F.lit(0.0)))

    return b.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(max_lag)), shifted)).alias("lag", "s")).groupBy(*keys, "lag").agg(F.sum("s").alias("s"))


def _correlated(products: DataFrame, den: DataFrame, keys: list[str]) -> DataFrame:
    r = F.round(F.when(F.col("den") > 0, F.col("s") / F.col("den")).otherwise(F.lit(0.0)), 6)
    return products.join(den.hint("merge"), "series").where("lag < n").select(*keys, "lag", r.alias("r"))


def fundamental_period(acf: DataFrame, min_lag: int = 2, tol: int = 2) -> DataFrame:
    """Per series the period: the most prominent peak, reduced to the least peak that it is a multiple of, if that one is
    half as prominent and recurs at twice its lag; null without a peak over 0.

    Prominence is the height over the higher of the two troughs at which the descent from the peak ends.
    """
    by = W.partitionBy("series").orderBy("lag")
    a = acf.withColumn("before", F.lag("r").over(by)).withColumn("after", F.lead("r").over(by)).withColumn("lags", F.count(F.lit(1)).over(W.partitionBy("series")))
    ends_left, ends_right = (F.col("lag") <= 1) | (F.col("before") > F.col("r")), F.col("after").isNull() | (F.col("after") > F.col("r"))
    a = a.withColumn("lo", F.last(F.when(ends_left, F.col("r")), True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    a = a.withColumn("hi", F.first(F.when(ends_right, F.col("r")), True).over(by.rowsBetween(1, W.unboundedFollowing)))
    # the peaks of a series are few and go with each of its rows, so that one pass tells all of them apart
    peak = (F.col("lag") >= min_lag) & (F.col("r") > F.col("before")) & (F.col("r") >= F.col("after")) & (F.col("r") > 0)
    a = a.withColumn("own", F.when(peak, F.round(F.col("r") - F.greatest("lo", "hi"), 6))).withColumn("peak", F.coalesce(peak, F.lit(False)))
    peaks = F.filter(F.collect_list(F.when(F.col("peak"), F.struct("lag", "own", "lags"))), lambda x: x.isNotNull())
    g = a.groupBy("series").agg(peaks.alias("p"), F.max(F.when(F.col("peak"), F.struct(F.col("own").alias("prominence"), (-F.col("lag")).alias("neg")))).alias("b"))
    best, top = -F.col("b.neg"), F.col("b.prominence")
    k = lambda x: F.bround(best / x["lag"])
    least = F.filter("p", lambda x: (x["lag"] < best) & (x["own"] >= 0.5 * top) & (k(x) >= 2) & (F.abs(best - k(x) * x["lag"]) <= tol) & (2 * x["lag"] < x["lags"]) & F.exists("p", lambda y: F.abs(y["lag"] - 2 * x["lag"]) <= tol))
    sub = F.array_min(F.transform(least, lambda x: x["lag"]))
    return g.select("series", F.coalesce(sub, best).alias("period"), top.alias("prominence"))


def fold(frames: DataFrame, period: int) -> DataFrame:
    """(series, phase, mean): scores by frame modulo the period."""
    return frames.groupBy("series", F.pmod("frame", F.lit(period)).cast("int").alias("phase")).agg(F.avg("score").alias("mean"))


def fold_fraction(frames: DataFrame, period: float, buckets: int) -> DataFrame:
    """(series, bucket, mean): scores by fraction of the period; a series with an empty bucket gives no rows."""
    f = frames.groupBy("series", F.floor(F.pmod(F.col("frame").cast("double"), F.lit(period)) * buckets / period).cast("int").alias("bucket")).agg(F.avg("score").alias("m"))
    whole = F.count(F.lit(1)).over(W.partitionBy("series")) == buckets
    return f.withColumn("_w", whole).where("_w").select("series", "bucket", F.col("m").alias("mean"))


def pulse_diagnose(folded: DataFrame, buckets: int) -> DataFrame:
    """Per series what its folded curve says: VBV starvation, normal drift, starved key frame, low IDR, or no clear shape.

    The first bucket holds the key frame. What counts is whether it stands over the mean, where the sixth after it
    stands, and whether the last sixth has recovered from that.
    """
    k = max(2, buckets // 6)
    a = folded.groupBy("series").agg(
        F.avg("mean").alias("all"), F.max(F.when(F.col("bucket") == 0, F.col("mean"))).alias("idr"), F.avg(F.when(F.col("bucket").between(1, k - 1), F.col("mean"))).alias("after"),
        F.avg(F.when(F.col("bucket") >= buckets - k, F.col("mean"))).alias("late"), (F.max("mean") - F.min("mean")).alias("amplitude"),
    )
    every, idr, after, late = (F.col(c) for c in ("all", "idr", "after", "late"))
    verdict = F.when(F.lit(buckets < 6), "too short").when((idr > every) & (after < every) & (late > after), "VBV starvation").when((idr > every) & (after > every) & (late < after), "normal drift")
    verdict = verdict.when((idr < every) & (late > every), "starved key frame").when(idr < every, "low IDR").otherwise("no clear shape")
    return a.select("series", F.round("amplitude", 6).alias("amplitude"), F.round(idr - every, 6).alias("idr_delta"), F.round(late - after, 6).alias("recovery"), verdict.alias("verdict"))


def permutation_significance(frames: DataFrame, max_lag: int, trials: int = 20, seed: int = 1, value: str = "score", block: int = 1024) -> DataFrame:
    """Per series the percent of shuffled copies whose greatest autocorrelation from lag 2 on is under the observed.

    Shuffling changes neither the mean nor the sum of squares, so a copy is the series' deviations in another order, and
    the series itself is the copy of trial 0, in its own.
    """
    d, den = _deviations(frames, value)
    keys = ["series", "trial"]
    t = d.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    shuffled = t.where("trial > 0").withColumn("frame", F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "trial", "frame"))) - 1)
    both = t.where("trial = 0").select(*keys, "frame", "d").unionByName(shuffled.select(*keys, "frame", "d"))
    r = _correlated(_products(both, keys, max_lag, block), den, keys).where("lag >= 2").groupBy(*keys).agg(F.max("r").alias("r"))
    own = r.groupBy("series").agg(F.max(F.when(F.col("trial") == 0, F.col("r"))).alias("observed"), F.collect_list(F.when(F.col("trial") > 0, F.col("r"))).alias("others"))
    under = F.aggregate("others", F.lit(0.0), lambda n, x: n + (x < F.col("observed")).cast("double"))
    return own.where(F.col("observed").isNotNull() & (F.size("others") > 0)).select("series", F.round(100 * (under / F.size("others")), 2).alias("significance"), "observed")


def series_summary(frames: DataFrame, gop: int) -> DataFrame:
    """Per series: frames, mean, minimum, deviation, the amplitude of the curve folded by the key frame distance, and the
    distance of the mean from that of all series."""
    a = frames.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.min("score").alias("low"), F.stddev_pop("score").alias("d"))
    amp = fold(frames, gop).groupBy("series").agg((F.max("mean") - F.min("mean")).alias("amp"))
    every = frames.agg(F.avg("score").alias("every"))
    return a.join(amp, "series").crossJoin(F.broadcast(every)).select("series", "n", F.lit(gop).alias("gop"), F.round("m", 4).alias("mean"), "low", F.round("d", 4).alias("deviation"), F.round("amp", 4).alias("amplitude"), F.round(F.col("m") - F.col("every"), 4).alias("from_mean"))
