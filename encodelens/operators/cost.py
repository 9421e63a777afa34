"""Cost and efficiency rollups over runs, machines and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.functions import scalars as S
from encodelens.operators.ranks import index_marks

#: Fixed values of the overhead model: assumed edge seconds and packing, their bounds, and the runs looked at.
EDGE_S, PACKING, LEAST_PACKING, MOST_IDLE, LAST_RUNS, FLEET_CAP = 116.0, 0.91, 0.25, 0.85, 10, 48


def attempt_reclaims(attempts: DataFrame, now: int) -> DataFrame:
    """(job, key, count, lost_s, total_s) of attempts (job, key, reason, started, stopped): what spot reclaims threw away.

    An attempt was reclaimed if its reason begins with `Host EC2` or says that something was terminated; what it ran is
    lost. An attempt without a stop after its start counts up to now in the total; one without a start does not count.
    """
    why = F.coalesce("reason", F.lit(""))
    gone = why.startswith("Host EC2") | F.contains(F.lower(why), F.lit("was terminated"))
    ran = F.col("stopped") > F.col("started")
    end = F.when(ran, F.col("stopped")).otherwise(F.lit(now))
    return attempts.groupBy("job", "key").agg(
        F.count_if(gone).alias("count"), F.coalesce(F.sum(F.when(gone & ran, F.col("stopped") - F.col("started"))), F.lit(0)).cast("double").alias("lost_s"),
        F.coalesce(F.sum(F.when(end > F.col("started"), end - F.col("started"))), F.lit(0)).cast("double").alias("total_s"),
    )


def reclaim_rollup(reclaims: DataFrame) -> DataFrame:
    """Per job: reclaims, lost and total seconds, waste in percent; counters of a stage only grow, so its greatest stands."""
    per = reclaims.groupBy("job", "key").agg(F.max("count").alias("count"), F.max("lost_s").alias("lost_s"), F.max("total_s").alias("total_s"))
    out = per.groupBy("job").agg(F.sum("count").alias("reclaims"), F.round(F.sum("lost_s"), 4).alias("lost_s"), F.round(F.sum("total_s"), 4).alias("total_s"))
    return out.withColumn("waste_pct", F.round(100 * F.col("lost_s") / F.nullif(F.col("total_s"), F.lit(0.0)), 4))


def stats_rollup(stats: DataFrame) -> DataFrame:
    """Per job over the last row of each exec: wall, vCPU hours, jobs, slowest, concurrency and efficiency."""
    last = stats.groupBy("job", "exec").agg(F.max_by(F.struct("wall_s", "vcpu_h", "jobs", "longest_s", "slowest", "max_vcpus"), "seq").alias("r")).select("job", "exec", "r.*")
    out = last.groupBy("job").agg(F.round(F.sum("wall_s"), 4).alias("wall_s"), F.round(F.sum("vcpu_h"), 4).alias("vcpu_h"), F.sum("jobs").alias("jobs"), F.max("longest_s").alias("longest_s"), F.max(F.struct("longest_s", "slowest"))["slowest"].alias("slowest"), F.max("max_vcpus").alias("max_vcpus"))
    used = F.col("vcpu_h") * 3600 / F.nullif(F.col("wall_s"), F.lit(0.0))
    return out.withColumn("concurrency", F.round(used, 4)).withColumn("efficiency", F.round(used / F.nullif(F.col("max_vcpus"), F.lit(0)), 4))


def cost_rollup(costs: DataFrame) -> DataFrame:
    """Per job: the ten components of the last row of each exec, summed, and the total of those that are billed."""
    billed = ["spot", "egress_usd", "sfn", "request", "storage", "put_est"]
    parts = ["spot", "ondemand", "saved", "egress_gb", "egress_usd", "egress_avoided_gb", "sfn", "request", "storage", "put_est"]
    last = costs.groupBy("job", "exec").agg(*[F.max_by(p, "seq").alias(p) for p in parts])
    out = last.groupBy("job").agg(F.count(F.lit(1)).alias("execs"), *[F.round(F.sum(p), 4).alias(p) for p in parts])
    return out.withColumn("total", F.round(sum(F.col(p) for p in billed), 4))


def _rented(jobs: DataFrame, instances: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Boxes that ran jobs, by exec, and boxes that ran none."""
    j = jobs.withColumn("stop", F.coalesce("stop_s", F.lit(now)))
    used = j.groupBy("exec", "instance").agg(F.min("start_s").alias("first_job"), F.max("stop").alias("last_job"), F.count(F.lit(1)).alias("jobs"), F.sum((F.col("stop") - F.col("start_s")) * F.col("vcpu")).alias("allocated_vcpu_s"))
    box = instances.select("instance", F.col("vcpu").alias("box_vcpu"), "launch", F.coalesce("ended", F.lit(now)).alias("end"))
    return used.join(box, "instance"), box.join(jobs.select("instance").distinct(), "instance", "left_anti")


def _life() -> Column:
    return F.greatest(F.col("end") - F.col("launch"), F.lit(0))


def _span(margin: int) -> list[Column]:
    """The ends of an exec's span, in which the launch of a box without jobs makes the box its own."""
    return [(F.min("launch") - margin).alias("lo"), (F.max("last_job") + margin).alias("hi")]


def machine_rental(jobs: DataFrame, instances: DataFrame, now: int, margin: int = 120, bucket_s: int = 3600) -> DataFrame:
    """Per exec and instance: life, idle before and after, busy and allocated vCPU seconds; unused boxes launched meanwhile.

    A box without jobs belongs to an exec if it was launched from `margin` seconds before the exec's first launch to
    `margin` after its last stop. The execs' windows meet launches by buckets of time, not as a product; the pairs are
    what is asked for here. rental_totals has their sums without them.
    """
    used, free = _rented(jobs, instances, now)
    windows = used.groupBy("exec").agg(*_span(margin)).withColumn("_at", F.explode(F.sequence(F.floor(F.col("lo") / bucket_s), F.floor(F.col("hi") / bucket_s))))
    unused = free.withColumn("_at", F.floor(F.col("launch") / bucket_s)).join(windows, "_at").where(F.col("launch").between(F.col("lo"), F.col("hi")))
    none = lambda n: F.lit(None).cast("long").alias(n)
    unused = unused.select("instance", "exec", none("first_job"), none("last_job"), F.lit(0).cast("long").alias("jobs"), F.lit(0).cast("long").alias("allocated_vcpu_s"), "box_vcpu", "launch", "end")
    out = used.unionByName(unused)
    life = _life()
    before = F.when(F.col("jobs") > 0, F.greatest(F.col("first_job") - F.col("launch"), F.lit(0))).otherwise(life)
    after = F.when(F.col("jobs") > 0, F.greatest(F.col("end") - F.col("last_job"), F.lit(0))).otherwise(F.lit(0))
    return out.select("exec", "instance", "jobs", "box_vcpu", life.alias("life_s"), before.alias("idle_before_s"), after.alias("idle_after_s"), "allocated_vcpu_s", (life * F.col("box_vcpu")).alias("rented_vcpu_s"))


def rental_totals(jobs: DataFrame, instances: DataFrame, now: int, margin: int = 120, block_s: int = 900) -> DataFrame:
    """Per exec: boxes, boxes without jobs (unused), rented and allocated vCPU seconds; the sums of machine_rental.

    What launched in a span is what launched up to its end less what launched before its start. Launches and the ends of
    spans become one row a second, whose running sums are taken in blocks of block_s seconds into which the sums of earlier
    blocks are carried; spans then read the sums at their two seconds. So execs and boxes make no pairs, and no task holds
    more seconds than a block has, however many spans end in it.
    """
    used, free = _rented(jobs, instances, now)
    rent = _life() * F.col("box_vcpu")
    figures = [F.count(F.lit(1)).alias("boxes"), F.sum(rent).alias("rent"), F.sum("allocated_vcpu_s").alias("allocated")]
    own = used.groupBy("exec").agg(*figures, *_span(margin)).withColumns({"lo": F.col("lo").cast("long"), "hi": F.col("hi").cast("long")})
    real = F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False))  # a span without both ends holds no launch
    ends = own.where(real).select(F.explode(F.array("lo", "hi")).alias("t"))
    launches = free.where("launch is not null").select(F.col("launch").cast("long").alias("t"), F.lit(1).cast("long").alias("n"), rent.cast("long").alias("rent"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    seconds = ends.unionByName(launches, allowMissingColumns=True).groupBy("t").agg(zero(F.sum("n")).alias("n"), zero(F.sum("rent")).alias("rent")).withColumn("block", F.floor(F.col("t") / block_s))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block, however many launches
    blocks = seconds.groupBy("block").agg(F.sum("n").alias("n"), F.sum("rent").alias("rent"))
    blocks = blocks.select("block", zero(F.sum("n").over(earlier)).alias("n_before"), zero(F.sum("rent").over(earlier)).alias("rent_before"))
    here = W.partitionBy("block").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    up_to = seconds.withColumns({"n_to": F.sum("n").over(here), "rent_to": F.sum("rent").over(here)}).join(blocks, "block")
    n_to, rent_to = F.col("n_to") + F.col("n_before"), F.col("rent_to") + F.col("rent_before")
    # launches at the second of a span's start are within it, so its start reads what came before that second
    start = up_to.select(F.col("t").alias("lo"), (n_to - F.col("n")).alias("n_lo"), (rent_to - F.col("rent")).alias("rent_lo"))
    end = up_to.select(F.col("t").alias("hi"), n_to.alias("n_hi"), rent_to.alias("rent_hi"))
    within = lambda c: F.when(real, zero(F.col(f"{c}_hi")) - zero(F.col(f"{c}_lo"))).otherwise(0)
    out = own.join(start, "lo", "left").join(end, "hi", "left").withColumns({"unused": within("n"), "more": within("rent")})
    return out.select("exec", (F.col("boxes") + F.col("unused")).alias("boxes"), "unused", (zero(F.col("rent")) + F.col("more")).alias("rented_vcpu_s"), F.col("allocated").alias("allocated_vcpu_s"))


def rental_attribution(totals: DataFrame) -> DataFrame:
    """rental_totals with the unallocated share in percent."""
    return totals.withColumn("unallocated_pct", F.round(100 * (1 - F.col("allocated_vcpu_s") / F.nullif(F.col("rented_vcpu_s"), F.lit(0))), 4))


def fleet_shape(rentals: DataFrame) -> DataFrame:
    """Per exec: vCPUs and edge vCPU hours, from launch to first job and from last job to end; a live box has no tail."""
    head = F.greatest(F.col("first_job") - F.col("launch"), F.lit(0))
    tail = F.when(F.col("alive"), 0).otherwise(F.greatest(F.col("end") - F.col("last_job"), F.lit(0)))
    return rentals.groupBy("exec").agg(F.sum("vcpu").alias("fleet_vcpu"), F.round(F.sum((head + tail) * F.col("vcpu")) / 3600.0, 4).alias("edge_vcpu_h"))


def run_cost(jobs: DataFrame, totals: DataFrame, traffic: DataFrame, spot: float = 0.014, ondemand: float = 0.036) -> DataFrame:
    """Per exec the bill: vCPU hours rented (else allocated), spot cost and saving, egress, transitions, requests, storage
    over the wall span, estimated puts and their total; with the slowest job (of equals the smallest id).

    Jobs count that stopped after they started. totals: of rental_totals. traffic (exec, egress_bytes, avoided_bytes, egress_files, staged_bytes,
    transitions) may lack an exec, whose bytes then are 0.
    """
    length = F.col("stop_s") - F.col("start_s")
    done = jobs.where(length > 0)
    j = done.groupBy("exec").agg(F.count(F.lit(1)).alias("jobs"), (F.max("stop_s") - F.min("start_s")).alias("wall_s"), F.max(length).alias("longest_s"), F.max_by("job_id", F.struct(length, -F.col("job_id"))).alias("slowest"), F.sum(length * F.col("vcpu")).alias("job_vcpu_s"))
    r = totals.select("exec", F.col("rented_vcpu_s").alias("rented"))
    out = j.join(r, "exec", "left").join(traffic, "exec", "left").na.fill(0)
    rented = F.col("rented") > 0
    h = F.when(rented, F.col("rented")).otherwise(F.col("job_vcpu_s")) / 3600.0
    usd = {
        "spot_usd": h * spot, "egress_usd": S.egress_usd(F.col("egress_bytes")), "sfn_usd": S.transitions_usd(F.col("transitions")), "request_usd": S.request_usd(F.lit(0), F.col("egress_files")),
        "storage_usd": S.storage_usd(F.col("staged_bytes") / 1e9, F.col("wall_s") / 3600.0), "put_est_usd": S.put_estimate_usd(F.col("staged_bytes") / 1e9),
    }
    return out.select(
        "exec", "jobs", "wall_s", "longest_s", "slowest", F.when(rented, "rented").otherwise("allocated").alias("basis"), F.round(h, 4).alias("vcpu_h"), F.round(h * ondemand, 4).alias("ondemand_usd"), F.round(h * (ondemand - spot), 4).alias("saved_usd"),
        F.round(F.col("egress_bytes") / 1e9, 4).alias("egress_gb"), F.round(F.col("avoided_bytes") / 1e9, 4).alias("egress_avoided_gb"), *[F.round(c, 6).alias(n) for n, c in usd.items()], F.round(sum(usd.values()), 4).alias("total_usd"),
    )


def cpu_by_tier(jobs: DataFrame, reserved: DataFrame) -> DataFrame:
    """Per codec and height: jobs, effective cores (mean CPU over mean encode seconds), use of the reservation; low under 60 %."""
    t = jobs.groupBy("codec", "height").agg(F.count(F.lit(1)).alias("jobs"), (F.avg("cpu_s") / F.nullif(F.avg("encode_s"), F.lit(0.0))).alias("cores"))
    out = t.join(reserved, ["codec", "height"], "left")
    pct = 100 * F.col("cores") / F.col("vcpu")
    return out.select("codec", "height", "jobs", F.round("cores", 4).alias("cores"), "vcpu", F.round(pct, 4).alias("used_pct"), (pct < 60).alias("low"))


def timing_cold_warm(jobs: DataFrame) -> DataFrame:
    """Per codec: mean run time of the first job of each instance (cold) and of the rest; a blank instance is never cold."""
    first = F.row_number().over(W.partitionBy("instance").orderBy("start_s", "job_id")) == 1
    j = jobs.where("stop_s is not null").withColumn("cold", first & F.col("instance").isNotNull()).withColumn("run_s", F.col("stop_s") - F.col("start_s"))
    return j.groupBy("codec").agg(F.count_if("cold").alias("cold_jobs"), F.round(F.avg(F.when(F.col("cold"), F.col("run_s"))), 1).alias("cold_s"), F.count_if(~F.col("cold")).alias("warm_jobs"), F.round(F.avg(F.when(~F.col("cold"), F.col("run_s"))), 1).alias("warm_s"))


def thread_load(stages: DataFrame, timings: DataFrame) -> DataFrame:
    """Per codec: CPU over the wall time of its encode stages, mean concurrency, and the 10, 50 and 90 % marks of CPU per encode second.

    stages (codec, started, ended): those with both ends tell the wall, first start to last end, waiting included.
    timings (codec, key, seq, encode_s, cpu_s): the last of a key stands. A mark is the ratio at index floor(p * n) of the
    sorted ratios; only the buckets that hold a mark are sorted. A timing without encode seconds has no ratio.
    """
    wall = stages.where("started is not null and ended is not null").groupBy("codec").agg((F.max("ended") - F.min("started")).alias("wall"))
    last = timings.groupBy("codec", "key").agg(F.max_by(F.struct("encode_s", "cpu_s"), "seq").alias("t")).select("codec", "t.*")
    sums = last.groupBy("codec").agg(F.count(F.lit(1)).alias("chunks"), F.sum("cpu_s").alias("cpu"), F.sum("encode_s").alias("enc"))
    marks = index_marks(last.withColumn("ratio", F.when(F.col("encode_s") > 0, F.col("cpu_s") / F.col("encode_s"))), "codec", "ratio", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("n")
    m = sums.join(wall, "codec").join(marks, "codec", "left")
    over = lambda c: F.round(F.col(c) / F.nullif(F.col("wall"), F.lit(0)), 4)
    return m.select("codec", F.col("chunks").alias("n"), over("cpu").alias("load"), over("enc").alias("concurrency"), *[F.round(p, 4).alias(p) for p in ("p10", "p50", "p90")])


def overlapping_runs(samples: DataFrame, key: str = "account") -> DataFrame:
    """samples with `overlaps`: whether the run's span meets that of another run of the account.

    Two running extremes over (start, end) order answer it without a self-join; a run without a span overlaps nothing.
    """
    has = F.col("started_at").isNotNull() & F.col("ended_at").isNotNull() & (F.col("ended_at") > F.col("started_at"))
    by = W.partitionBy(key, has).orderBy("started_at", "ended_at", "run")
    before = F.max("ended_at").over(by.rowsBetween(W.unboundedPreceding, -1)) > F.col("started_at")
    after = F.lead("started_at").over(by) < F.col("ended_at")  # in start order the next start is the least
    return samples.withColumn("overlaps", has & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))))


def overhead_model(samples: DataFrame) -> DataFrame:
    """Per account: edge seconds a vCPU and packing, medians over the last 10 runs that tell them, else the assumptions."""
    s = overlapping_runs(samples).where(~F.col("overlaps") & (F.col("fleet_vcpu") > 0))
    s = s.withColumn("edge_s", F.col("edge") * 3600 / F.col("fleet_vcpu"))
    s = s.withColumn("packing", F.when(F.col("machine") > F.col("edge"), F.col("allocated") / (F.col("machine") - F.col("edge"))))

    def last(c: str) -> DataFrame:
        rn = F.row_number().over(W.partitionBy("account").orderBy(F.col("started_at").desc(), F.col("run").desc()))
        return s.where(F.col(c) > 0).withColumn("rn", rn).where(F.col("rn") <= LAST_RUNS).groupBy("account").agg(F.median(c).alias(c), F.count(F.lit(1)).alias(f"n_{c}"))

    out = samples.select("account").distinct().join(last("edge_s"), "account", "left").join(last("packing"), "account", "left")
    pack = F.least(F.greatest(F.coalesce("packing", F.lit(PACKING)), F.lit(LEAST_PACKING)), F.lit(1.0))
    return out.select("account", F.round(F.coalesce("edge_s", F.lit(EDGE_S)), 4).alias("edge_s"), F.round(pack, 4).alias("packing"), F.coalesce("n_edge_s", F.lit(0)).alias("n_edge"), F.coalesce("n_packing", F.lit(0)).alias("n_packing"))


def machine_hours(allocated, fleet, edge_s, packing):
    """Machine vCPU hours of an allocation: packed, plus the fleet's edges."""
    return allocated / packing + fleet * edge_s / 3600


def idle_fraction(allocated, machine):
    return F.least(F.greatest(1 - allocated / F.nullif(machine, F.lit(0.0)), F.lit(0.0)), F.lit(MOST_IDLE))


def spot_savings(samples: DataFrame, now: int) -> DataFrame:
    """Per account: saved dollars of all time and of the last day, lost minutes, waste in percent."""
    day = F.col("ended_at").between(now - 86400, now)
    return samples.groupBy("account").agg(F.round(F.sum("saved_usd"), 4).alias("saved_usd"), F.round(F.coalesce(F.sum(F.when(day, F.col("saved_usd"))), F.lit(0.0)), 4).alias("saved_day_usd"), F.round(F.sum("lost_s") / 60, 4).alias("lost_min"), F.round(100 * F.sum("lost_s") / F.nullif(F.sum("total_s"), F.lit(0.0)), 4).alias("waste_pct"))


def append_capped(log: DataFrame, fresh: DataFrame, key: str, order: list[str], keep: int) -> DataFrame:
    """A log with new rows, of each key the newest `keep`."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return log.unionByName(fresh).withColumn("_rn", rn).where(F.col("_rn") <= keep).drop("_rn")


def merge_store(store: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """An upsert by natural key: the incoming row wins; among incoming rows of one key, the greatest."""
    both = store.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in store.columns if c not in key]
    return both.groupBy(*key).agg(F.max(F.struct("_new", *rest)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
