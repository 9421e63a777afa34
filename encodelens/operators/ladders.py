"""Ladders, rates, speeds and plans over tables of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.functions import scalars as S
from encodelens.operators.ordered import fold_in_order

# Fixed prices a minute by height band (over lo, up to hi): vendor, codec, lo, hi, dollars.
RATES = [
    (v, c, lo, hi, usd)
    for v, c, bands in [
        ("commercial", "h264", [(0, 719, 0.005), (719, 1080, 0.010), (1080, 1440, 0.025), (1440, 99999, 0.045)]),
        ("commercial", "hevc", [(0, 719, 0.008), (719, 1080, 0.015), (1080, 1440, 0.038), (1440, 99999, 0.068)]),
        ("commercial", "av1", [(0, 719, 0.010), (719, 1080, 0.020), (1080, 1440, 0.050), (1440, 99999, 0.090)]),
        ("mediaconvert", "h264", [(0, 719, 0.0075), (719, 1080, 0.015), (1080, 99999, 0.03)]),
        ("mediaconvert", "hevc", [(0, 719, 0.017), (719, 1080, 0.034), (1080, 99999, 0.068)]),
        ("mediaconvert", "av1", [(0, 719, 0.017), (719, 1080, 0.034), (1080, 99999, 0.068)]),
        ("coconut", "h264", [(0, 719, 0.0075), (719, 1080, 0.015), (1080, 99999, 0.03)]),
        ("bitmovin", "h264", [(0, 719, 0.02), (719, 1080, 0.04), (1080, 2160, 0.08), (2160, 99999, 2.4)]),
        ("bitmovin", "hevc", [(0, 719, 0.04), (719, 1080, 0.08), (1080, 2160, 0.16), (2160, 99999, 4.8)]),
        ("bitmovin", "av1", [(0, 719, 0.04), (719, 1080, 0.08), (1080, 2160, 0.16), (2160, 99999, 4.8)]),
    ]
    for lo, hi, usd in bands
]
GRID_S, SEARCH, RUNT_S, EPS, QUANTUM, LOCAL_FLOOR, LOCAL_CORES = 6, 240, 2.0, 1e-6, 12, 240.0, 16
#: Requests that a set holds, and about as many rungs as one task meets with the sets of their ladder.
REQUESTS_A_SET, RUNGS_A_TASK = 512, 2048
#: Fixed values of the chunk budget: the first target in seconds, and how often it is doubled.
TARGET_S, DOUBLINGS = 240.0, 12


def codec_ladders(rungs: DataFrame) -> DataFrame:
    """rungs with the rungs of av1 taken from each ladder's hevc column, which serves both."""
    kept = rungs.where(F.col("codec") != "av1")
    return kept.unionByName(kept.where(F.col("codec") == "hevc").withColumn("codec", F.lit("av1")).select(*rungs.columns))


def resolve_rungs(rungs: DataFrame, requests: DataFrame | None = None, min_height: int = 0, max_height: int = 99999, overrides: dict[int, int] | None = None) -> DataFrame:
    """Rungs with labels, repeated heights numbered over the whole ladder in its order, then the height band and no upscaling.

    With requests (request, ladder, src_width) one row per request and rung; rungs wider than the source go, unless its
    width is unknown (null, 0 or less). overrides: rates in kbps by height, for all rungs of that height.
    """
    by = W.partitionBy("ladder", "codec", "height")
    many = F.count(F.lit(1)).over(by) > 1
    label = F.concat(F.col("height"), F.lit("p"), F.when(many, F.concat(F.lit("_"), F.row_number().over(by.orderBy("pos")))).otherwise(F.lit("")))
    out = rungs.withColumn("label", label).where(F.col("height").between(min_height, max_height))
    if overrides:
        out = out.withColumn("kbps", F.coalesce(S.lookup(overrides, F.col("height")).cast(rungs.schema["kbps"].dataType), F.col("kbps")))
    return out if requests is None else all_pairs(out, requests)


def request_sets(requests: DataFrame, same: list[str], size: int = REQUESTS_A_SET) -> DataFrame:
    """Requests that agree in the columns `same` as rows of up to `size` of them: `same`, and `_set`, an array of the other columns."""
    part = F.floor((F.row_number().over(W.partitionBy(*same).orderBy("request")) - 1) / size)
    rest = F.struct(*[c for c in requests.columns if c not in same])
    return requests.withColumn("_part", part).groupBy(*same, "_part").agg(F.collect_list(rest).alias("_set")).drop("_part")


def met(sets: DataFrame, rungs: DataFrame, keys: list[str], takes: Callable[[Column], Column], tasks: int) -> DataFrame:
    """A row per set and rung of equal keys that takes(a request of the set), in as many tasks as are told, as the bytes that
    come in say nothing of the pairs.

    Rungs follow each other set by set, so once the sets are taken apart a rung's columns stay as they are from request to
    request and the same requests return from rung to rung: tables written of pairs in this order are small. As the
    condition looks into the set, Spark does not compile the join into one loop with what takes sets apart, which would
    hold all pairs of a set and its rungs at once; it passes them on rung by rung.
    """
    if tasks > 1:
        sets, rungs = (x.repartition(tasks, *keys) for x in (sets, rungs))
    return sets.hint("merge").join(rungs, keys).where(F.exists("_set", takes))


def all_pairs(rungs: DataFrame, requests: DataFrame, slices: int = 32, same: tuple[str, ...] = ("ladder",), once: dict[str, Column] | None = None) -> DataFrame:
    """for_requests where each rung of a ladder is asked for: a ladder is cut into slices, so that its pairs are made by
    many tasks and no other row is moved. Requests that agree in the columns `same` meet a rung as a set.

    once: further columns by name, of columns of rungs and of `same`, found once for a set and rung.
    """
    takes = lambda w: (F.coalesce(w, F.lit(0)) <= 0) | (F.col("width") <= w)
    mine = rungs.withColumn("_slice", F.pmod(F.xxhash64("pos"), F.lit(slices)).cast("int"))
    asked = request_sets(requests, [*same]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    each = lambda x: takes(F.col("src_width") if "src_width" in same else x["src_width"])
    j = met(asked, mine, ["ladder", "_slice"], each, -(-rungs.count() // RUNGS_A_TASK)).withColumns(once or {})
    j = j.select(F.inline("_set"), *[c for c in j.columns if c not in ("_set", "_slice")])
    return j.where(takes(F.col("src_width")))


def for_requests(rungs: DataFrame, requests: DataFrame) -> DataFrame:
    """A row per request and rung of its ladder; rungs wider than the source go, unless its width is unknown."""
    return requests.join(rungs, "ladder").where((F.coalesce("src_width", F.lit(0)) <= 0) | (F.col("width") <= F.col("src_width")))


def rung_groups(rungs: DataFrame) -> DataFrame:
    """A ladder's rungs of equal codec and size as one row: `n`, how many they are, and `kbps`, their rates summed.

    Figures summed over the rungs of a request (quotes, makespans, plans) take these rows as they take single rungs, so
    that requests meet the few sizes of a ladder and not each of its rungs.
    """
    return rungs.groupBy("ladder", "codec", "width", "height").agg(F.count(F.lit(1)).alias("n"), F.sum("kbps").alias("kbps"))


def _number(rungs: DataFrame) -> Column:
    """How many rungs a row stands for: 1, but for rung_groups."""
    return F.col("n") if "n" in rungs.columns else F.lit(1).cast("long")


def band_gate(rungs: DataFrame, min_height: int, max_height: int) -> DataFrame:
    """Ladders and codecs of which the height band leaves no rung, with their own range and the reason."""
    a = rungs.groupBy("ladder", "codec").agg(F.min("height").alias("lowest"), F.max("height").alias("highest"), F.count_if(F.col("height").between(min_height, max_height)).alias("n"))
    why = F.when(F.col("lowest") > max_height, "all above the band").when(F.col("highest") < min_height, "all below the band").otherwise("none within the band")
    return a.where("n = 0").select("ladder", "codec", "lowest", "highest", why.alias("reason"))


def ladder_constraints(rungs: DataFrame) -> DataFrame:
    """Rungs that break a rule, one row a rule: sizes and rates over 0, known codecs, 1 or 2 passes, no shell characters
    or substitutions in extra arguments. passes and extra_args may be missing or null."""
    rules = {"size": (F.col("width") <= 0) | (F.col("height") <= 0), "rate": F.col("kbps") <= 0, "codec": ~F.col("codec").isin(*S.CODECS)}
    if "passes" in rungs.columns:
        rules["passes"] = ~F.col("passes").isin(1, 2)
    if "extra_args" in rungs.columns:
        rules["extra_args"] = F.col("extra_args").rlike(r"[;|&<>`\n\r]|\$\(|\$\{")
    broken = F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rungs.select("ladder", "codec", "pos", F.explode(broken).alias("rule"))


def rates(spark, table=None) -> DataFrame:
    return spark.createDataFrame(table or RATES, "vendor string, rate_codec string, lo int, hi int, usd_min double")


def tier_rates(rungs: DataFrame, rate_table: DataFrame) -> DataFrame:
    """Rungs with each vendor's dollars a minute: the band of their height, of their codec or else of h264.

    What a vendor lacks is filled in the price list first, so that a rung meets its vendors by codec and once each.
    """
    lists = rate_table.groupBy("vendor").agg(F.collect_list(F.struct("rate_codec", "lo", "hi", "usd_min")).alias("bands"))
    codecs = F.explode(F.array(*[F.lit(c) for c in (*S.CODECS, "")]))
    own = F.filter("bands", lambda b: b["rate_codec"] == F.col("_codec"))
    base = F.filter("bands", lambda b: b["rate_codec"] == "h264")
    lists = lists.withColumn("_codec", codecs).select("vendor", "_codec", F.inline(F.when(F.size(own) > 0, own).otherwise(base))).drop("rate_codec")
    j = rungs.withColumn("_codec", F.when(F.col("codec").isin(*S.CODECS), F.col("codec")).otherwise(F.lit("")))
    j = j.join(F.broadcast(lists), "_codec").where((F.col("height") > F.col("lo")) & (F.col("height") <= F.col("hi")))
    return j.select(*rungs.columns, "vendor", "usd_min")


def saas_quote(rungs: DataFrame, rate_table: DataFrame) -> DataFrame:
    """Per request and vendor: minutes times rates times the vendor's own multiplier; two vendors add audio, one repacking.

    The multiplier is of frame rate and source bit rate (commercial), double over 30 frames a second (mediaconvert), or
    of two passes (bitmovin). Rungs of equal codec and height are priced once. Audio counts where has_audio is true.
    """
    t = rungs.groupBy("request", "duration", "fps", "two_pass", "src_mbps", "has_audio", "codec", "height").agg(F.sum(_number(rungs)).alias("n"))
    t = tier_rates(t, rate_table)
    mult = F.when(F.col("vendor") == "commercial", S.fps_mult(F.col("fps")) * S.bitrate_mult(F.col("src_mbps")))
    mult = mult.when((F.col("vendor") == "mediaconvert") & (F.col("fps") > 30), 2.0).when((F.col("vendor") == "bitmovin") & F.col("two_pass"), 1.25).otherwise(1.0)
    repack = F.when(F.col("vendor") == "commercial", 0.003).otherwise(0.0)
    q = t.groupBy("request", "duration", "has_audio", "vendor").agg(F.sum(F.col("n") * (F.col("usd_min") * mult + repack)).alias("a_min"), F.sum("n").alias("rungs"))
    audio = F.when(~F.col("has_audio"), 0.0).when(F.col("vendor") == "commercial", 0.001).when(F.col("vendor") == "coconut", 0.00325).otherwise(0.0)
    return q.select("request", "vendor", "rungs", F.round((F.col("a_min") + audio) * F.col("duration") / 60, 4).alias("usd"))


#: Fixed names of the cloud's machine and of the local machine that stands for all of which nothing is learned.
CLOUD_MACHINE, LOCAL_MACHINE = "graviton", "ubuntu"


def with_local_speed(rungs: DataFrame, learned: DataFrame) -> DataFrame:
    """Rungs with `speed`: the mean of what local machines have learned of this rung, else the seed; and learned_n, those machines."""
    l = learned.where((F.col("machine") != CLOUD_MACHINE) & (F.col("speed") > 0)).groupBy("codec", "height").agg(F.avg("speed").alias("_speed"), F.count(F.lit(1)).alias("_n"))
    seed = S.seed_speed(F.col("codec"), F.col("height"), F.col("two_pass"), F.lit("medium"), F.col("fps"), F.lit(LOCAL_MACHINE))
    return rungs.join(l, ["codec", "height"], "left").withColumn("speed", F.coalesce("_speed", seed)).withColumn("learned_n", F.coalesce("_n", F.lit(0))).drop("_speed", "_n")


def with_speed(rungs: DataFrame, learned: DataFrame, machine: str) -> DataFrame:
    """Rungs with `speed`: the learned one of this machine and rung, else the seed; and learned_n."""
    l = learned.where(F.col("machine") == machine).select("codec", "height", F.col("speed").alias("_speed"), F.col("n").alias("_n"))
    seed = S.seed_speed(F.col("codec"), F.col("height"), F.col("two_pass"), F.lit("medium"), F.col("fps"), F.lit(machine))
    return rungs.join(l, ["codec", "height"], "left").withColumn("speed", F.coalesce("_speed", seed)).withColumn("learned_n", F.coalesce("_n", F.lit(0))).drop("_speed", "_n")


def speed_lookup(learned: DataFrame) -> DataFrame:
    """Per codec and height over machines: mean speed, the slowest and mean of machines that are not cloud, and samples."""
    local = F.col("machine") != CLOUD_MACHINE
    return learned.groupBy("codec", "height").agg(F.round(F.avg("speed"), 4).alias("mean"), F.round(F.avg(F.when(local, F.col("speed"))), 4).alias("local_mean"), F.round(F.min(F.when(local, F.col("speed"))), 4).alias("local_slowest"), F.sum("n").alias("n"))


def batch_source(files: DataFrame) -> DataFrame:
    """What a request of several files (request, pos, duration, width, fps, limit_s) is quoted on: duration, src_width, fps, files.

    Durations that are known, over 0, are summed; a limit in seconds, as text, caps what is encoded at as often itself as
    there are files, those of unknown duration too, and one that is no number over 0 is none. Width and frame rate are those
    of the first file of known duration and width; without one the width is 0 and the rate that of the last file of known
    duration. A request none of whose durations is known has no row.
    """
    known = F.coalesce(F.col("duration") > 0, F.lit(False))
    wide = known & F.coalesce(F.col("width") > 0, F.lit(False))
    limit = F.max(F.expr("try_cast(limit_s as double)"))
    a = files.groupBy("request").agg(
        F.sum(F.when(known, F.col("duration"))).alias("sum"), F.count(F.lit(1)).alias("files"), limit.alias("limit"),
        F.min_by(F.struct(F.col("width").alias("w"), F.col("fps").alias("f")), F.when(wide, F.col("pos"))).alias("first"), F.max_by("fps", F.when(known, F.col("pos"))).alias("last"),
    ).where("sum > 0")
    most = F.when(F.col("limit") > 0, F.col("limit") * F.col("files"))
    return a.select("request", F.least("sum", most).alias("duration"), F.coalesce("first.w", F.lit(0)).alias("src_width"), F.when(F.col("first").isNotNull(), F.col("first.f")).otherwise(F.col("last")).alias("fps"), "files")


def cloud_quote(rungs: DataFrame, edge_s: float = 116.0, packing: float = 0.91, spot: float = 0.014, ondemand: float = 0.036, cap: int = 48) -> DataFrame:
    """Per request: allocated and machine vCPU hours, fleet, spot and on-demand dollars, idle share, output GB and egress.

    rungs carry speed. Allocation is duration / speed times the reservation; the fleet is what the widest moment
    could use, up to a cap.
    """
    v = S.vcpu_for(F.col("codec"), F.col("height")) * _number(rungs)
    r = rungs.groupBy("request", "duration").agg(F.sum(F.col("duration") / F.col("speed") * v / 3600).alias("alloc"), F.sum(v).alias("wave"), F.sum(F.col("kbps") * F.col("duration") * 1000 / 8 / 1e9).alias("gb"))
    fleet = F.least(F.col("wave"), F.lit(cap))
    machine = F.col("alloc") / packing + fleet * edge_s / 3600
    r = r.withColumn("fleet_vcpu", fleet).withColumn("machine", machine)
    idle = F.least(F.greatest(1 - F.col("alloc") / F.col("machine"), F.lit(0.0)), F.lit(0.85))
    return r.select("request", "fleet_vcpu", F.round("alloc", 4).alias("allocated_vcpu_h"), F.round("machine", 4).alias("machine_vcpu_h"), F.round(F.col("machine") * spot, 4).alias("spot_usd"), F.round(F.col("machine") * ondemand, 4).alias("ondemand_usd"), F.round(idle, 4).alias("idle"), F.round("gb", 4).alias("output_gb"), F.round(F.col("gb") * S.PRICES["egress_gb"], 4).alias("egress_usd"))


def estimate_rows(requests: DataFrame, quotes: DataFrame, cloud: DataFrame, local: DataFrame) -> DataFrame:
    """One row per request with everything that is known before it runs: cloud dollars, egress, vendors, local wall time.

    total_usd is what the run is billed: spot and egress in the cloud, nothing on a local target (`local`).
    """
    vendors = ["commercial", "mediaconvert", "coconut", "bitmovin"]
    q = quotes.groupBy("request").pivot("vendor", vendors).agg(F.first("usd")).withColumnsRenamed({v: f"{v}_usd" for v in vendors})
    out = requests.select("request", "local").join(cloud, "request", "left").join(local, "request", "left").join(q, "request", "left")
    total = F.when(F.col("local"), 0.0).otherwise(F.round(F.col("spot_usd") + F.col("egress_usd"), 4))
    return out.select("request", "local", "spot_usd", "ondemand_usd", F.round(100 * F.col("idle"), 4).alias("idle_pct"), F.col("output_gb").alias("egress_gb"), "egress_usd", total.alias("total_usd"), *[f"{v}_usd" for v in vendors], F.col("wall_s").alias("local_wall_s"), F.col("learned").alias("local_wall_learned"), F.col("rungs").alias("local_wall_rungs"))


def local_makespan(rungs: DataFrame, cores: int = LOCAL_CORES) -> DataFrame:
    """Per request: the larger of all core seconds over the cores and the longest rung's, which counts up to 240 s."""
    wall = F.col("duration") / F.col("speed")
    n = _number(rungs)
    c = wall * S.vcpu_for(F.col("codec"), F.col("height")) * n
    out = rungs.groupBy("request").agg(F.greatest(F.sum(c) / cores, F.max(F.least(wall, F.lit(LOCAL_FLOOR)))).alias("w"), F.sum(F.when(F.col("learned_n") > 0, n).otherwise(F.lit(0).cast("long"))).alias("learned"), F.sum(n).alias("rungs"))
    return out.select("request", F.round("w", 4).alias("wall_s"), "learned", "rungs")


def grid(segment: Column) -> Column:
    """The least multiple of 6 s, up to 240 units, that is also one of the segment; else the segment itself."""
    units = F.filter(F.sequence(F.lit(1), F.lit(SEARCH)), lambda k: F.abs(k * GRID_S / segment - F.round(k * GRID_S / segment)) < EPS)
    return F.coalesce(F.try_element_at(units, F.lit(1)) * F.lit(float(GRID_S)), segment)


def grid_of(segment: float) -> float:
    """grid() of one segment length that is known beforehand."""
    return next((float(k * GRID_S) for k in range(1, SEARCH + 1) if abs(k * GRID_S / segment - round(k * GRID_S / segment)) < EPS), segment)


def _plan_shape(duration: Column, chunk: Column, g: Column) -> tuple[Column, Column]:
    units = F.greatest(F.ceil(duration / g - EPS), F.lit(1))
    n = F.least(F.greatest(F.ceil(duration / chunk - EPS), F.lit(1)), units)
    return n.cast("long"), units.cast("long")


def planned_chunks(duration: Column, chunk: Column, step: Column) -> Column:
    """The number of planned chunks on a grid of `step` seconds after a runt tail is folded."""
    n, units = _plan_shape(duration, chunk, step)
    last = step * ((n - 1) * F.floor(units / n) + F.least(n - 1, units % n))
    return F.when((n > 1) & (duration - last < RUNT_S), n - 1).otherwise(n)


def chunk_counts(df: DataFrame) -> DataFrame:
    """df (duration, chunk, segment) with n, the number of planned chunks."""
    return df.withColumn("n", planned_chunks(F.col("duration"), F.col("chunk"), grid(F.col("segment"))))


def chunk_plan(df: DataFrame) -> DataFrame:
    """One row per chunk of each (duration, chunk, segment): index, start, length; chunks tile the clip on the grid.

    Units of the grid are dealt evenly, larger chunks first; the last chunk ends with the clip, and a tail of under
    2 s joins its neighbour. aligned tells whether the chunk is a multiple of the segment.
    """
    others = df.columns
    g = df.withColumn("grid", grid(F.col("segment")))
    n, units = _plan_shape(F.col("duration"), F.col("chunk"), F.col("grid"))
    g = g.withColumn("units", units).withColumn("planned", n)
    g = g.withColumn("base", F.floor(F.col("units") / F.col("planned"))).withColumn("extra", F.col("units") % F.col("planned"))
    start = lambda i: F.col("grid") * (i * F.col("base") + F.least(i, F.col("extra")))
    tail = (F.col("planned") > 1) & (F.col("duration") - start(F.col("planned") - 1) < RUNT_S)
    g = g.withColumn("n", F.when(tail, F.col("planned") - 1).otherwise(F.col("planned")))
    g = g.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    end = F.when(F.col("index") == F.col("n") - 1, F.col("duration")).otherwise(start(F.col("index") + 1))
    aligned = F.abs(F.col("chunk") / F.col("segment") - F.round(F.col("chunk") / F.col("segment"))) < EPS
    g = g.withColumn("start", F.round(start(F.col("index")), 4)).withColumn("length", F.round(end - start(F.col("index")), 4))
    return g.select(*others, F.col("index").cast("int").alias("index"), "start", "length", aligned.alias("aligned"))


#: Events that a run's history holds and a chunk writes, bytes of its input and the share kept for spans, fixed
#: lengths that are advised, and what a span's text has besides its numbers.
HISTORY, EVENTS_A_CHUNK, INPUT_BYTES, INPUT_SHARE, ADVISED_S = 25_000, 8, 262_144, 0.8, (30, 60, 90, 120, 180, 240)
SPAN = '{"index":,"start_s":"","duration_s":""}'


def _digits(x: Column) -> Column:
    """Decimal digits of a whole number from 0 on."""
    return sum((F.when(x >= 10**d, 1).otherwise(0) for d in range(1, 10)), F.lit(1)).cast("long")


def plan_bytes(duration: Column, chunk: Column, step: Column) -> Column:
    """The length of a plan written as a JSON list of spans (index, start and length with six decimals), without its chunks.

    Indexes and starts only grow, so the digits of all are counted by how many reach each power of ten; lengths
    are of two kinds, but for the last.
    """
    shaped, units = _plan_shape(duration, chunk, step)
    n = planned_chunks(duration, chunk, step)
    base, extra = F.floor(units / shaped).cast("long"), (units % shaped).cast("long")
    start = lambda i: step * (i * base + F.least(i, extra))
    none = F.lit(0).cast("long")
    digits = 2 * n
    for d in range(1, 10):
        reach = F.ceil(10**d / step - EPS).cast("long")
        first = F.when(reach <= extra * (base + 1), F.ceil(reach / (base + 1))).otherwise(extra + F.ceil((reach - extra * (base + 1)) / base)).cast("long")
        digits = digits + F.greatest(n - 10**d, none) + F.greatest(n - first, none)
    long = F.least(extra, n - 1)
    last = F.round(duration - start(n - 1), 6)
    digits = digits + long * _digits(F.floor(step * (base + 1))) + (n - 1 - long) * _digits(F.floor(step * base)) + _digits(F.floor(last))
    return (digits + n * (len(SPAN) + 14) + n - 1 + 2).cast("long")


def plan_fit(rungs: DataFrame, segment: float = 6.0) -> DataFrame:
    """Per request (rungs: request, duration, chunk, codec, height): chunks, history events, bytes of its spans, the vCPUs that all
    chunks at once could use, which limit the plan fails (`history`, `input`, `history and input`, null: it fits), and the
    least advised fixed length whose history fits, null if none does."""
    step = F.lit(float(grid_of(segment)))
    n, d = planned_chunks(F.col("duration"), F.col("chunk"), step), F.col("duration")
    many = _number(rungs)
    n = n * many
    tries = [F.sum(planned_chunks(d, F.lit(float(s)), step) * many).alias(f"_{s}") for s in ADVISED_S]
    r = rungs.groupBy("request").agg(F.sum(n).alias("chunks"), F.sum(plan_bytes(d, F.col("chunk"), step) * many).alias("bytes"), F.sum(n * S.vcpu_for(F.col("codec"), F.col("height"))).alias("peak_vcpu"), *tries)
    events = F.col("chunks") * EVENTS_A_CHUNK
    long, large = events > HISTORY, F.col("bytes") > int(INPUT_BYTES * INPUT_SHARE)
    fails = F.when(long & large, "history and input").when(long, "history").when(large, "input")
    advice = F.coalesce(*[F.when(F.col(f"_{s}") * EVENTS_A_CHUNK <= HISTORY, s) for s in ADVISED_S])
    return r.select("request", "chunks", events.alias("events"), "bytes", "peak_vcpu", fails.alias("fails"), advice.alias("advice_s"))


def chunk_size(target: Column, speed: Column, duration: Column, mode: Column) -> Column:
    """Seconds a chunk: the target at this speed in steps of 12, or the whole clip; 12 at least, the clip at most."""
    dynamic = F.greatest(F.round(target * speed / QUANTUM), F.lit(1.0)) * QUANTUM
    return F.when(mode == "whole", duration).otherwise(F.least(F.when(mode == "fixed", F.greatest(target, F.lit(float(QUANTUM)))).otherwise(dynamic), duration))


def chunk_budget_sweep(rungs: DataFrame, budget: int = 2500, segment: float = 6.0) -> DataFrame:
    """Per request the least target whose planned chunks fit the budget, with the counts at the first target and there.

    A request that fits at 240 s keeps that. Else the target doubles, up to 12 times, until one fits, and is halved in
    between down to a second; if none fits, the largest tried stands with its count. Rungs of equal speed are counted
    once, so a request is one row with as many numbers as it has codecs and heights, and searches in that row.
    """
    r = rungs.groupBy("request", "duration", "speed").agg(F.sum(_number(rungs)).alias("n"))
    r = r.groupBy("request", "duration").agg(F.collect_list(F.struct("speed", "n")).alias("rungs"))
    step = F.lit(float(grid_of(segment)))

    def count(target: Column) -> Column:
        def one(x: Column) -> Column:
            return x["n"] * planned_chunks(F.col("duration"), chunk_size(target, x["speed"], F.col("duration"), F.lit("dynamic")), step)

        return F.aggregate("rungs", F.lit(0).cast("long"), lambda acc, x: acc + one(x).cast("long"))

    tries = F.transform(F.sequence(F.lit(0), F.lit(DOUBLINGS)), lambda k: F.struct((F.lit(TARGET_S) * F.pow(F.lit(2.0), k)).alias("t")))
    r = r.withColumn("tries", F.transform(tries, lambda x: F.struct(x["t"].alias("t"), count(x["t"]).alias("n"))))
    r = r.withColumn("hi", F.coalesce(F.try_element_at(F.filter("tries", lambda x: x["n"] <= budget), F.lit(1))["t"], F.lit(TARGET_S * 2.0**DOUBLINGS)))
    fits = F.exists("tries", lambda x: x["n"] <= budget)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        good = count(mid) <= budget
        go = acc["hi"] - acc["lo"] > 1.0
        return F.struct(F.when(go & ~good, mid).otherwise(acc["lo"]).alias("lo"), F.when(go & good, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct((F.col("hi") / 2).alias("lo"), F.col("hi").alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(DOUBLINGS + 8))
    r = r.withColumn("target", F.when(~fits | (F.col("hi") == TARGET_S), F.col("hi")).otherwise(F.aggregate(steps, start, halve)["hi"]))
    return r.select("request", F.element_at("tries", 1)["n"].alias("before"), F.round("target", 6).alias("target"), count(F.col("target")).alias("after"))


def effective_config(configs: DataFrame) -> DataFrame:
    """configs (job_x and ladder_x for x of segment, partial, gop and tag, job_chunk, as text) with what each resolves to.

    The job's value counts before the ladder's and that before the default; an empty one is unset, `0` is not. Without
    a tag, the output of a ladder that pins no segment is tagged xs, else with its segment.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    first = lambda x, default: F.coalesce(text(f"job_{x}"), text(f"ladder_{x}"), F.lit(default))
    pinned = F.concat(text("ladder_segment"), F.lit("s"))
    tag = F.coalesce(text("job_tag"), text("ladder_tag"), pinned, F.lit("xs"))
    return configs.withColumns({"segment_s": first("segment", "6"), "partial_s": first("partial", "0.2"), "gop_s": first("gop", "1.0"), "tag": tag, "chunk": F.coalesce(text("job_chunk"), F.lit("dynamic"))})


def predicted_wall_rank(groups: DataFrame, rungs: DataFrame) -> DataFrame:
    """Rungs of a request by predicted wall time, the slowest first; hevc wins ties, then ladder order.

    groups: requests with the rung_groups of their ladder and `speed`; rungs: the ladders. Rungs of a group have one wall
    time, so groups are ordered, and what goes before them counted, by request; groups of one request that tie are a set,
    of which the rungs are numbered once for all requests. The pairs are what is asked for: they come from the last join,
    in which requests that rank a rung alike meet it together, and are neither sorted nor moved.
    """
    wall = F.col("duration") / F.col("speed")
    size = F.struct("codec", "width", "height")
    tied = groups.groupBy("request", "ladder", F.round(wall, 6).alias("w"), (F.col("codec") == "hevc").alias("hevc")).agg(
        F.array_sort(F.collect_list(F.struct(size.alias("size"), F.round(wall, 4).alias("wall_s")))).alias("g"), F.sum("n").alias("n")
    )
    upto = F.sum("n").over(W.partitionBy("request").orderBy(F.col("w").desc(), F.col("hevc").desc()))
    tied = tied.select("request", "ladder", (upto - F.col("n")).alias("before"), F.transform("g", lambda x: x["size"]).alias("set"), F.transform("g", lambda x: x["wall_s"]).alias("walls"))
    numbered = tied.select("ladder", "set").distinct().select("ladder", "set", F.posexplode("set").alias("at", "size")).select("ladder", "set", "at", "size.*")
    place = F.row_number().over(W.partitionBy("ladder", "set").orderBy("pos"))
    placed = numbered.join(rungs.select("ladder", "codec", "width", "height", "pos"), ["ladder", "codec", "width", "height"]).withColumn("place", place).drop("width")
    sets = request_sets(tied, ["ladder", "set", "before"])
    j = met(sets, placed, ["ladder", "set"], lambda x: F.size(x["walls"]) > F.col("at"), -(-rungs.count() // RUNGS_A_TASK)).withColumn("rank", (F.col("before") + F.col("place")).cast("int"))
    out = j.select(F.inline("_set"), "codec", "pos", "height", "at", "rank")
    return out.select("request", "codec", "pos", "height", F.get("walls", F.col("at")).alias("wall_s"), "rank")


def decode_bands(rungs: DataFrame, budget_mp: float = 4.0, max_height: int = 1080) -> DataFrame:
    """Rungs that share a decode: by rising pixels, a band takes rungs until it would pass the budget; singles go.

    The rungs of a ladder and codec pass in order with one state held.
    """

    def step(state: tuple | None, rung: tuple) -> tuple:
        _, mp, pos, height, ladder, codec = rung
        band, used = state or (0, 0.0)
        band, used = (band + 1, mp) if used > 0 and used + mp > budget_mp else (band, used + mp)
        return (band, used), (ladder, codec, band, pos, height, mp)

    mp = (F.col("width") * F.col("height") / 1e6).alias("mp")
    key = F.to_json(F.struct("ladder", "codec")).alias("of")
    rows = rungs.where(F.col("height") <= max_height).select(key, mp, F.col("pos").cast("long").alias("pos"), F.col("height").cast("int").alias("height"), "ladder", "codec")
    f = fold_in_order(rows, "of", ["mp", "pos", "height"], "ladder string, codec string, band int, pos long, height int, mp double", step)
    by = W.partitionBy("ladder", "codec", "band")
    f = f.withColumn("size", F.count(F.lit(1)).over(by)).withColumn("at", F.row_number().over(by.orderBy(F.col("mp").desc(), "pos")))
    return f.where("size > 1").select("ladder", "codec", "band", "pos", "height", "size", "at")
