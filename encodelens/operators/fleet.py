"""Fleet samples, machine states, burn rates and learned speeds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.operators.blocks import ROWS_A_BLOCK, block_of, cuts, fold_in_blocks
from encodelens.operators.ordered import fold_in_order

#: Seconds between accepted samples, samples kept, seconds a machine stays listed, a poller fresh, a member in grace.
GAP_S, RING, TTL_S, FRESH_S, GRACE_S = 3, 90, 600, 150, 300


def worker_state(configured: DataFrame, pollers: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Per machine: disabled, polling (listed and fresh), stale or never, and the age of its last poll, 0 at least."""
    j = configured.join(pollers.select("machine", F.lit(True).alias("listed")).distinct(), "machine", "full_outer").join(seen.groupBy("machine").agg(F.max("last_poll").alias("last_poll")), "machine", "full_outer")
    age = F.greatest(F.lit(now) - F.col("last_poll"), F.lit(0))
    state = F.when(F.coalesce("disabled", F.lit(False)), "disabled").when(F.coalesce("listed", F.lit(False)) & (age <= FRESH_S), "polling").when(F.col("last_poll").isNotNull(), "stale").otherwise("never")
    return j.select("machine", state.alias("state"), age.alias("age_s"), F.col("disabled").isNotNull().alias("configured"))


def instance_state(instances: DataFrame, members: DataFrame, now: int) -> DataFrame:
    """Per instance, the first that holds: leaving, booting (no member in grace), draining, running, pulling, idle."""
    j = instances.join(members, "instance", "left")
    age = F.lit(now) - F.col("launch")
    state = F.when(F.col("state") == "terminated", "leaving").when(F.col("registered").isNull() & (age < GRACE_S), "booting").when(F.coalesce("draining", F.lit(False)), "draining").when(F.col("running") > 0, "running").when(F.col("pending") > 0, "pulling").otherwise("idle")
    return j.select("instance", state.alias("init_state"), age.alias("age_s"))


def terminated_at(df: DataFrame, col: str = "reason") -> DataFrame:
    """df with ended: the time in brackets in a state transition's reason; null if there is none."""
    t = F.try_to_timestamp(F.regexp_extract(col, r"\((\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) GMT\)", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    return df.withColumn("ended", F.unix_timestamp(t))


def live_fleet_filter(fleet: DataFrame, instances: DataFrame | None) -> DataFrame:
    """Rows of machines that the inventory has and has not terminated; without an inventory (None or no rows) all rows."""
    if instances is None:
        return fleet
    live = instances.where("state <> 'terminated'").select(F.col("instance").alias("machine")).distinct().withColumn("_live", F.lit(True))
    known = instances.agg((F.count(F.lit(1)) > 0).alias("_known"))
    out = fleet.join(live, "machine", "left").crossJoin(F.broadcast(known))
    return out.where(F.coalesce("_live", F.lit(False)) | ~F.col("_known")).drop("_live", "_known")


def enrich_fleet(jobs: DataFrame, instances: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per instance: vCPUs used by running jobs and idle, and the running jobs, the newest first.

    A job that occurs twice counts once. What runs on a box is bounded by its size. members (member, instance): jobs
    name a cluster member, and that its machine; a job whose member is not known is on no machine.
    """
    if members is not None:
        jobs = jobs.join(members.where("member is not null").dropDuplicates(["member"]), "member", "left")
    run = jobs.where("status = 'RUNNING'").groupBy("job_id").agg(F.min(F.struct("start_s", "instance", "vcpu")).alias("r")).select("job_id", "r.*")
    use = run.groupBy("instance").agg(F.sum("vcpu").alias("u"), F.count(F.lit(1)).alias("jobs"))
    top = run.withColumn("rn", F.row_number().over(W.partitionBy("instance").orderBy(F.col("start_s").desc(), "job_id")))
    top = top.groupBy("instance").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "job_id"))), lambda x: x["job_id"].cast("string")), ",").alias("newest"))
    used = F.least(F.coalesce("u", F.lit(0)), F.col("box_vcpu"))
    return instances.withColumnRenamed("vcpu", "box_vcpu").join(use, "instance", "left").join(top, "instance", "left").select("instance", "type", "box_vcpu", used.alias("used_vcpu"), (F.col("box_vcpu") - used).alias("idle_vcpu"), F.coalesce("jobs", F.lit(0)).alias("jobs"), "newest")


def inventory_summary(instances: DataFrame, objects: DataFrame | None, now: int, max_age_s: int) -> DataFrame:
    """One row: running and old instances, dollars an hour, and bytes stored, null if they were not measured."""
    live = F.col("state") == "running"
    a = instances.agg(F.count_if(live).alias("running"), F.count_if(live & (F.col("launch") < now - max_age_s)).alias("orphans"), F.round(F.sum(F.when(live, F.coalesce("spot_price", F.col("vcpu") * 0.036))), 4).alias("hourly_usd"))
    b = objects.agg(F.sum("bytes").alias("bytes")) if objects is not None else instances.sparkSession.range(1).select(F.lit(None).cast("long").alias("bytes"))
    return a.crossJoin(F.broadcast(b))


def action_summary(actions: DataFrame) -> DataFrame:
    """Per scope the number of rows of each action."""
    return actions.groupBy("scope").agg(*[F.count_if(F.col("action") == a).alias(a.replace("-", "_")) for a in ("would-delete", "deleted", "skipped", "held")])


def version_skew(samples: DataFrame) -> DataFrame:
    """Per fleet: known versions of its machines' last known samples, whether they are mixed, and machines without one."""
    m = samples.groupBy("fleet", "machine").agg(F.max_by("version", F.when(F.col("version").isNotNull(), F.col("seq"))).alias("version"))
    return m.groupBy("fleet").agg(F.count_distinct("version").alias("versions"), (F.count_distinct("version") > 1).alias("mixed"), F.count_if(F.col("version").isNull()).alias("unknown"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("seen"))


def speed_ewma(samples: DataFrame, weight: float = 0.3, digits: int = 10, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Per key the learned speed: the first sample, then old and new in parts 0.7 and 0.3, in seq order; and its samples.

    A run of samples takes any speed s to a * s + b. Keys are cut into blocks of seq, whose (a, b, n) are found apart
    and put together in order, so no key is sorted whole. Samples that are not over 0 do not count.
    """
    good = samples.where("speed > 0")
    bounds = cuts(good, "seq", rows_a_block)
    key = ["machine", "codec", "height"]
    s = good.withColumn("_block", block_of("seq", bounds))
    if bounds:  # a task for each block's number of rows, whatever their packed bytes
        s = s.repartition(len(bounds) + 1, *key, "_block")
    part = W.partitionBy(*key, "_block")
    s = s.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_i", F.row_number().over(part.orderBy("seq", "speed")))
    later = F.pow(F.lit(1 - weight), F.col("_n") - F.col("_i"))  # what is left of a sample at the end of its block
    blocks = s.groupBy(*key, "_block").agg(F.first("_n").alias("n"), F.sum(weight * F.col("speed") * later).alias("b"), F.max(F.when(F.col("_i") == 1, F.col("speed") * later)).alias("head"))
    by = W.partitionBy(*key).orderBy("_block")
    after = F.coalesce(F.sum("n").over(by.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    first = F.row_number().over(by) == 1  # the very first sample counts whole, not with its weight
    blocks = blocks.withColumn("_left", F.pow(F.lit(1 - weight), after)).withColumn("_add", F.col("b") + F.when(first, (1 - weight) * F.col("head")).otherwise(0.0))
    return blocks.groupBy(*key).agg(F.round(F.sum(F.col("_add") * F.col("_left")), digits).alias("speed"), F.sum("n").alias("n"))


def spend_integral(samples: DataFrame, now: int, window_s: int = 86400, lookback_s: int = 0, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Per fleet the dollars spent in the trailing window: trapezoids of the rate; gaps of over an hour do not count.

    A fleet is cut into blocks of time, each with sums of its own; only a block's first and last sample meet those of its neighbours.
    """
    s = samples.where(F.col("ts").between(now - window_s - lookback_s, now))
    s = s.withColumn("_block", block_of("ts", cuts(s, "ts", rows_a_block)))
    area = lambda dt, a, b: F.when((dt > 0) & (dt <= 3600), (a + b) / 2 * dt / 3600)
    by = W.partitionBy("fleet", "_block").orderBy("ts", "seq")
    s = s.withColumn("_a", area(F.lead("ts").over(by) - F.col("ts"), F.col("rate"), F.lead("rate").over(by)))
    end = F.struct("ts", "seq", "rate")
    blocks = s.groupBy("fleet", "_block").agg(F.sum("_a").alias("spent"), F.count(F.lit(1)).alias("n"), F.min(end).alias("first"), F.max(end).alias("last"))
    after = F.lead("first").over(W.partitionBy("fleet").orderBy("_block"))
    seam = area(after["ts"] - F.col("last.ts"), F.col("last.rate"), after["rate"])
    blocks = blocks.withColumn("_seam", seam)
    return blocks.groupBy("fleet").agg(F.round(F.coalesce(F.sum("spent"), F.lit(0.0)) + F.coalesce(F.sum("_seam"), F.lit(0.0)), 4).alias("spent"), F.sum("n").alias("samples"))


def downsample_history(samples: DataFrame, now: int, window_s: int = 7200, most: int = 180, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Per fleet the samples of the trailing window, every so many of them that about `most` stay, with the use in percent.

    A sample's place is the number of samples in earlier blocks of time, plus its place within its own block.
    """
    s = samples.where(F.col("ts").between(now - window_s, now))
    s = s.withColumn("_block", block_of("ts", cuts(s, "ts", rows_a_block)))
    blocks = s.groupBy("fleet", "_block").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy("fleet")
    blocks = blocks.withColumn("_n", F.sum("_c").over(whole)).withColumn("_before", F.sum("_c").over(whole.orderBy("_block")) - F.col("_c")).drop("_c")
    place = F.row_number().over(W.partitionBy("fleet", "_block").orderBy("ts", "seq")) - 1
    s = s.withColumn("_i", place).join(blocks, ["fleet", "_block"]).withColumn("_i", F.col("_i") + F.col("_before"))
    stride = F.when(F.col("_n") > most, F.floor(F.col("_n") / most) + 1).otherwise(1)
    return s.where(F.col("_i") % stride == 0).select("fleet", "seq", "ts", F.round(100 * F.col("busy") / F.col("perf"), 4).alias("used_pct"))


def fleet_throttle(samples: DataFrame, gap_s: int = GAP_S, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Samples that count: the first of a machine and each that comes gap_s or more after the last that counted.

    Which sample counts depends on the one before. A machine's samples, reduced to one a second, the most that can
    matter, are cut into blocks of time; a block tells for each sample that could be its first to count which is the last.
    """

    def step(last: int | None, sample: tuple) -> tuple:
        _, ts, seq = sample
        return (ts, (seq,)) if last is None or ts - last >= gap_s else (last, None)

    def effect(rows: Iterator[tuple]) -> list[tuple[int, int]]:
        ts = [r[1] for r in rows]
        last, j = ts[:], len(ts)
        for i in range(len(ts) - 1, -1, -1):
            while j > i + 1 and ts[j - 1] - ts[i] >= gap_s:
                j -= 1
            if j < len(ts):
                last[i] = last[j]
        starts = [i for i, t in enumerate(ts) if t < ts[0] + gap_s]
        return [(ts[i], last[i]) for i in range(min(len(ts), len(starts) + 1))]

    def through(last: int | None, starts: list[tuple[int, int]]) -> int | None:
        return next((end for t, end in starts if last is None or t - last >= gap_s), last)

    one = samples.where("ts is not null").groupBy("machine", F.col("ts").cast("long").alias("ts")).agg(F.min("seq").alias("seq"))
    return samples.join(fold_in_blocks(one, "machine", ["ts"], "seq long", None, step, effect, through, rows_a_block=rows_a_block), "seq", "left_semi")


def fleet_view(samples: DataFrame, now: int, ttl_s: int = TTL_S, ring: int = RING, gap_s: int = GAP_S) -> DataFrame:
    """Per machine whose last counted sample is at most ttl_s old: its use and age, the uses of its last `ring` counted samples
    and their mean, its chunks, version and first sight.

    Counted samples are those of fleet_throttle. The chunk list is that of the last sample, counted or not, the version
    the last that any sample named, and a machine is first seen with its first sample. A use without a perf is 0.
    """
    by = W.partitionBy("machine").orderBy(F.col("ts").desc(), F.col("seq").desc())
    pct = F.when(F.col("perf") > 0, 100 * F.col("busy") / F.col("perf")).otherwise(0.0)
    at = F.struct("ts", "seq")
    last = samples.groupBy("machine").agg(F.max_by("version", F.when(F.coalesce("version", F.lit("")) != "", at)).alias("version"), F.min("ts").alias("first_seen"), F.max_by("chunks", at).alias("chunks"))
    s = fleet_throttle(samples, gap_s).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= ring)
    history = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("rn"), F.round(pct, 4).alias("pct")))), lambda x: x["pct"])
    s = s.groupBy("machine").agg(F.max("ts").alias("ts"), F.round(F.max(F.when(F.col("rn") == 1, pct)), 4).alias("used_pct"), F.round(F.avg(pct), 4).alias("mean_pct"), F.count(F.lit(1)).alias("samples"), history.alias("history"))
    return s.where(F.col("ts") >= now - ttl_s).join(last, "machine").select("machine", (F.lit(now) - F.col("ts")).alias("age_s"), "used_pct", "mean_pct", "samples", "history", "chunks", "version", "first_seen")


def usage_order(usage: DataFrame, key: list[str]) -> DataFrame:
    """Prefixes of a key by the bytes they hold, the largest first, ties by name, with their place."""
    return usage.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(F.col("bytes").desc(), "prefix")))


def phase_order(phases: DataFrame) -> DataFrame:
    """Phases of a job in the order in which they were first seen, ties by name, with their place."""
    return phases.withColumn("place", F.row_number().over(W.partitionBy("job").orderBy("first_seq", "phase")))


def fleet_order(view: DataFrame) -> DataFrame:
    """Machines in the order in which they were first seen, unknown ones last, ties by name, with their place."""
    return view.withColumn("place", F.row_number().over(W.partitionBy("fleet").orderBy(F.col("first_seen").asc_nulls_last(), "machine")))


def host_counter_rate(counters: DataFrame, cores: int, min_s: float = 2.0) -> DataFrame:
    """(machine, seq, busy): busy cores between a reading and the baseline, of counters that only grow.

    The first reading of a machine is the baseline. A reading less than min_s seconds after it waits, and the baseline
    stays, so that no window is shorter; one whose total has not grown, as after a restart, becomes the baseline and tells nothing.
    """

    def step(base: tuple | None, reading: tuple) -> tuple:
        machine, ts, seq, idle, total = reading
        if base is None:
            return (ts, idle, total), None
        if ts - base[0] < min_s:
            return base, None
        if total <= base[2]:
            return (ts, idle, total), None
        return (ts, idle, total), (machine, seq, max(0.0, (1 - (idle - base[1]) / (total - base[2])) * cores))

    rows = counters.select("machine", F.col("ts").cast("double"), F.col("seq").cast("long"), F.col("idle").cast("double"), F.col("total").cast("double")).dropna()
    machine = rows.schema["machine"].dataType.simpleString()
    return fold_in_order(rows, "machine", ["ts", "seq"], f"machine {machine}, seq long, busy double", step).withColumn("busy", F.round("busy", 4))


def host_dedup(rows: DataFrame) -> DataFrame:
    """Rows of an activity at which its machine or version changes."""
    now, before = F.struct("machine", "version"), F.lag(F.struct("machine", "version")).over(W.partitionBy("activity").orderBy("seq"))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | ~now.eqNullSafe(F.col("_b"))).drop("_b")


def recent_executions(execs: DataFrame, top: int = 25) -> DataFrame:
    """The `top` executions: running first, then the newest; an arn counts once."""
    one = execs.groupBy("arn").agg(F.max(F.struct("started", "status")).alias("r")).select("arn", "r.started", "r.status")
    return one.orderBy((F.col("status") == "RUNNING").desc(), F.col("started").desc(), "arn").limit(top)


def active_jobs_order(jobs: DataFrame) -> DataFrame:
    """Jobs by status rank, then the latest of their times, the newest first, with their place in their queue."""
    rank = F.when(F.col("status") == "RUNNING", 0).when(F.col("status") == "STARTING", 1).when(F.col("status") == "RUNNABLE", 2).when(F.col("status") == "SUBMITTED", 3).otherwise(4)
    at = F.greatest("start_s", F.coalesce("stop_s", F.lit(0)))
    return jobs.withColumn("latest", at).withColumn("place", F.row_number().over(W.partitionBy("exec").orderBy(rank, F.col("latest").desc(), "job_id")))


def volumes_view(volumes: DataFrame, instances: DataFrame, prices: DataFrame) -> DataFrame:
    """Live instances with an hourly estimate: the spot price, else the list price of the type, else 0; and loose volumes."""
    p = instances.where("state <> 'terminated'").join(prices, "type", "left")
    i = p.select(F.concat(F.lit("i-"), F.col("instance")).alias("id"), F.lit("instance").alias("kind"), F.round(F.coalesce("spot_price", "list_price", F.lit(0.0)), 4).alias("hourly_usd"))
    v = volumes.where("attached is null").select(F.concat(F.lit("v-"), F.col("volume")).alias("id"), F.lit("volume").alias("kind"), F.round(F.col("gb") * 0.08 / 730, 4).alias("hourly_usd"))
    return i.unionByName(v)


def stale_instances(instances: DataFrame, now: int, max_age_s: int) -> DataFrame:
    """Running and pending instances of max_age_s or more, with age, hourly cost and label; 0 turns the check off."""
    age = F.lit(now) - F.col("launch")
    live = F.col("state").isin("running", "pending") & (F.lit(max_age_s) > 0) & (age >= max_age_s)
    return instances.where(live).select("instance", "type", "state", age.alias("age_s"), F.round(F.coalesce("spot_price", F.col("vcpu") * 0.036), 4).alias("hourly_usd"), F.concat("type", F.lit("/"), F.col("instance").cast("string")).alias("label"))
