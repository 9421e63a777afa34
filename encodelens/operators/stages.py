"""Stage intervals and what is counted over them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.functions.scalars import basename, ordered_sum, phase_key, rounded, seed_weighted, stage_codec
from encodelens.operators.blocks import ROWS_A_BLOCK, fold_in_blocks

# Ranks of stage states; interrupts may follow any state but a final one.
RANK = {"pending": 0, "queued": 1, "starting": 2, "running": 3, "reclaimed": 3, "failed": 4, "done": 5}
INTERRUPTS = ("failed", "reclaimed")


def rank(status: Column) -> Column:
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(status == name, r).otherwise(out)
    return out


def stages_for(stages: DataFrame, file: str | None = None, codec: str | None = None) -> DataFrame:
    """Stages of one file and one codec; stages that name no codec are shared and stay."""
    out = stages.withColumn("codec", stage_codec("key"))
    if file is not None:
        out = out.where(basename("file") == file.rsplit("/", 1)[-1])
    return out if codec is None else out.where(F.col("codec").isNull() | (F.col("codec") == codec))


def phase_rollup(stages: DataFrame) -> DataFrame:
    """Per job and phase (a key without its chunk): count, span, wall, worker and CPU seconds, cores, peak, shared.

    first_seq orders phases as first seen. Open intervals have no wall seconds.
    """
    s = stages.withColumn("phase", phase_key("key"))
    wall = F.when(F.col("ended").isNotNull() & F.col("started").isNotNull(), F.greatest(F.col("ended") - F.col("started"), F.lit(0)))
    out = s.groupBy("job", "phase").agg(
        F.count(F.lit(1)).alias("n"), (F.max("ended") - F.min("started")).alias("span_s"), F.sum(wall).alias("wall_s"),
        F.round(F.sum("worker_s"), 4).alias("worker_s"), F.round(F.sum("cpu_s"), 4).alias("cpu_s"),
        F.round(F.sum("cpu_s") / F.nullif(F.sum(wall), F.lit(0)), 4).alias("cores"), F.max("peak_mib").alias("peak_mib"), F.min("seq").alias("first_seq"),
    )
    return out.withColumn("shared", stage_codec("phase").isNull())


def active_time(stages: DataFrame, now: int | Column) -> DataFrame:
    """Per job: queued, active, span and idle seconds; active is the length of the union of its intervals.

    Stages without a start never ran and are skipped; open intervals end at `now`; an end before the start has no
    length; abutting intervals merge. A job none of whose stages ran has been queued since its submission.
    """
    now = F.lit(now) if isinstance(now, int) else now
    # one pass and one shuffle, by job: each interval adds what reaches past the greatest end before it, so that equal
    # intervals may come in any order; rows without a start come last and add nothing, but keep their job
    end = F.when(F.col("started").isNotNull(), F.greatest(F.coalesce("ended", now), "started"))
    run = stages.select("job", "submitted", F.col("started").alias("s"), end.alias("e"))
    order = W.partitionBy("job").orderBy(F.col("s").asc_nulls_last(), "e")
    reached = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    added = F.when(F.col("s").isNotNull(), F.greatest(F.col("e") - F.greatest("s", reached), F.lit(0)))
    jobs = run.withColumn("added", added).groupBy("job").agg(F.sum("added").alias("active_s"), F.min("s").alias("first"), F.max("e").alias("last"), F.min("submitted").alias("submitted"))
    span = F.coalesce(F.col("last") - F.col("first"), F.lit(0))
    active = F.coalesce("active_s", F.lit(0))
    queued = F.greatest(F.coalesce("first", now) - F.col("submitted"), F.lit(0))
    return jobs.select("job", queued.alias("queued_s"), active.alias("active_s"), span.alias("span_s"), (span - active).alias("idle_s"))


def rung_summary(stages: DataFrame) -> DataFrame:
    """Per job and codec: distinct encoded heights, the lowest and highest, and labels tallest first."""
    e = stages.withColumn("codec", stage_codec("key")).where(F.col("codec").isNotNull())
    tall = F.transform(F.array_sort(F.collect_set(F.struct((-F.col("height")).alias("h"), F.concat(F.col("height"), F.lit("p")).alias("l")))), lambda x: x["l"])
    return e.groupBy("job", "codec").agg(F.count_distinct("height").alias("rungs"), F.min("height").alias("lowest"), F.max("height").alias("highest"), F.array_join(tall, ",").alias("labels"))


def timing_report(stages: DataFrame, now: int) -> DataFrame:
    """(job, kind, label, n, seconds, place): a job's stages by seq, its phases as first seen, and five totals.

    The totals tell apart what one number cannot: the sum of all stages, the time in which any ran, the wait before the
    first, the gaps in between, and the wall clock.
    """
    took = F.when(F.col("started").isNotNull() & F.col("ended").isNotNull(), F.greatest(F.col("ended") - F.col("started"), F.lit(0)))
    one = stages.select("job", F.lit("stage").alias("kind"), F.col("key").alias("label"), F.lit(1).cast("long").alias("n"), took.alias("seconds"), F.col("seq").alias("place"))
    phases = phase_rollup(stages).select("job", F.lit("phase").alias("kind"), F.col("phase").alias("label"), "n", F.col("wall_s").alias("seconds"), F.col("first_seq").alias("place"))
    sums = stages.groupBy("job").agg(F.sum(took).alias("measured"), (F.lit(now) - F.min("submitted")).alias("wall"))
    t = active_time(stages, now).join(sums, "job")
    names = {"total measured": "measured", "active": "active_s", "queued": "queued_s", "idle": "idle_s", "wall clock": "wall"}
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).cast("long").alias("seconds"), F.lit(i).cast("long").alias("place")) for i, (n, c) in enumerate(names.items(), 1)])
    totals = t.select("job", F.inline(rows)).select("job", F.lit("total").alias("kind"), "label", F.lit(None).cast("long").alias("n"), "seconds", "place")
    return one.unionByName(phases).unionByName(totals)


def registers(events: DataFrame) -> DataFrame:
    """Per key what its events say, as registers that merge in any order: each keeps the value of its least or greatest seq.

    events: (key, seq, kind, sent, status, percent, instance, version, cpu_s, total_s, mem_mib) of the kinds STAGE, HOST,
    TIMING and REUSED; fields of other kinds are null. A null seq counts as 0.
    """
    seq, kind = F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.col("kind")
    of = lambda on, *cols: F.when(on, F.struct(seq, *cols))
    stage, host = kind == "STAGE", kind == "HOST"
    return events.groupBy("key").agg(
        F.min(F.when(stage | (kind == "REUSED"), seq)).alias("created"), F.min(of(stage & (F.col("status") == "running"), "sent")).alias("start"), F.min(of(stage & F.col("status").isin("done", "failed"), "sent")).alias("end"),
        F.max(of(stage, "status", "percent")).alias("state"), F.max(of(host, "instance")).alias("host"), F.max(of(host & (F.coalesce("version", F.lit("")) != ""), "version")).alias("build"),
        F.max(of(kind == "TIMING", "cpu_s", "total_s", "mem_mib")).alias("timing"), F.max(kind == "REUSED").alias("reused"), F.count_if(stage).alias("events"), F.count(F.lit(1)).alias("seen"),
    )


def merge_registers(parts: DataFrame) -> DataFrame:
    """Registers of the same keys from several parts of the events, in any grouping and order, as one row a key."""
    least, most = [F.min(c).alias(c) for c in ("created", "start", "end")], [F.max(c).alias(c) for c in ("state", "host", "build", "timing", "reused")]
    return parts.groupBy("key").agg(*least, *most, F.sum("events").alias("events"), F.sum("seen").alias("seen"))


def stage_rows(regs: DataFrame, *more: str) -> DataFrame:
    """One row per key that a stage or reuse marker has created, with further columns of the registers if named.

    The first running starts it, the first final state ends it, the last state and percent stand; before any, a reused
    key is pending at 0. The last host and timing count if they came after the key was there, a version that was named
    is not erased by a host that names none.
    """
    late = lambda r, f: F.when(F.col(f"{r}.seq") > F.col("created"), F.col(f"{r}.{f}"))
    return regs.where("created is not null").select(
        "key", F.col("start.sent").alias("started"), F.col("end.sent").alias("ended"), F.coalesce("state.status", F.lit("pending")).alias("status"), F.coalesce("state.percent", F.lit(0.0)).alias("percent"),
        late("host", "instance").alias("instance"), late("build", "version").alias("version"), *[late("timing", c).alias(c) for c in ("cpu_s", "total_s", "mem_mib")], F.coalesce("reused", F.lit(False)).alias("reused"), "events", *more,
    )


def stage_materialize(events: DataFrame) -> DataFrame:
    """stage_rows of all events; the same on a stream of events, in update mode, as registers merge in its state."""
    return stage_rows(registers(events))


def rendered_width(status: Column, percent: Column) -> Column:
    return F.when(status.isin("pending", "queued", "starting"), 0.0).when(status.isin("done", "skipped", "reclaimed"), 100.0).otherwise(F.coalesce(percent, F.lit(0.0)))


def after(state: tuple, status: str | None, percent: float | None) -> tuple[bool, tuple]:
    """(accepted, state) of a key in `state` (status, percent) that meets a transition.

    A done stage stays done; a lower rank is refused unless the stage had failed or is interrupted; an unknown percent
    carries the last one (0 at first); within a state that is not done the percent never falls.
    """
    old, had = state
    percent = had if percent is None else percent
    if None not in (old, status):
        if old == "done" != status or (RANK.get(status, 0) < RANK.get(old, 0) and old != "failed" and status not in INTERRUPTS):
            return False, state
        if old == status != "done":
            percent = max(percent, had)
    return True, (status, percent)


#: Stands for any status without a rank that a block may begin with and does not itself hold.
OTHER = "\0"


def transitions_effect(rows: Iterator[tuple]) -> list[tuple]:
    """What a run of transitions (key, seq, status, percent, src) does to any state, as (statuses before, status after, carries, percent).

    The percent after is the greater of `percent` and, if it carries, the one before. States that have met stay
    together, so that soon one or two are followed.
    """
    ways = [([s], s, True, float("-inf")) for s in (None, OTHER, *RANK)]
    seen = {None, *RANK}
    for _, _, status, percent, _ in rows:
        if status not in seen:  # a block may have begun with it, and was then like OTHER until here
            seen.add(status)
            froms, now, carries, least = next(w for w in ways if OTHER in w[0])
            if now == OTHER:
                ways.append(([status], status, carries, least))
            else:
                froms.append(status)
        new: dict[tuple, list] = {}
        for froms, old, carries, least in ways:
            accepted, (now, _) = after((old, 0.0), status, percent)
            if accepted and percent is not None:
                carries, least = (carries, max(least, percent)) if None not in (old, status) and old == status != "done" else (False, percent)
            new.setdefault((now, carries, least), []).extend(froms)
        ways = [(froms, *way) for way, froms in new.items()]
    return ways


def through_transitions(state: tuple, effect: list[tuple]) -> tuple:
    way = next((w for w in effect if state[0] in w[0]), None) or next(w for w in effect if OTHER in w[0])
    return state[0] if way[1] == OTHER else way[1], max(state[1], way[3]) if way[2] else way[3]


def stage_state_fold(events: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Each transition with whether it is accepted (see after()), and the state and width of its key after it.

    Events of a key pass in seq order. A key of many events is cut into blocks of seq: the effect of a block is a table
    over the states with a running maximum of percent, and each block is then replayed from where it begins.
    """

    def step(state: tuple, event: tuple) -> tuple:
        key, seq, status, percent, src = event
        accepted, state = after(state, status, percent)
        return state, (key, seq, src, accepted, *state)

    rows = events.select("key", F.col("seq").cast("long"), "status", F.col("percent").cast("double"), "src")
    out = fold_in_blocks(rows, "key", ["seq", "status", "percent", "src"], "key string, seq long, src string, accepted boolean, status string, percent double", (None, 0.0), step, transitions_effect, through_transitions, rows_a_block=rows_a_block)
    return out.withColumn("width", rendered_width(F.col("status"), F.col("percent")))


def width_regressions(folded: DataFrame, least: float = 0.05) -> DataFrame:
    """Accepted transitions after which the rendered width has moved by over `least`, with both widths."""
    w = F.lag("width").over(W.partitionBy("key").orderBy("seq"))
    out = folded.where("accepted").withColumn("before", w)
    return out.where(F.abs(F.col("width") - F.col("before")) > least).withColumn("backwards", F.col("width") < F.col("before"))


def weighted_progress(stages: DataFrame, now: int, pipeline_share: float = 0.1) -> DataFrame:
    """Per job the percent done: variants weighted by the inverse of their seed speed, the pipeline with a tenth of all.

    output_progress is the plain mean over variants, which are few and summed in one order. eta_s: the rest at the pace so
    far since the job's first start, 0 at 1 percent or less, from 99.5 on, and before any start.
    """
    pct = F.when(F.col("status") == "done", 100.0).when(F.col("status") == "failed", 0.0).otherwise(F.coalesce("percent", F.lit(0.0)))
    s = stages.withColumn("codec", stage_codec("key")).withColumn("pct", pct)
    v = s.where(F.col("codec").isNotNull()).groupBy("job", "codec", "height").agg(F.avg("pct").alias("pct"))
    w = lambda x: ordered_sum(seed_weighted(x, F.col("codec"), F.col("height")))
    v = v.groupBy("job").agg(w(F.col("pct")).alias("vp"), w(F.lit(1.0)).alias("vw"), (ordered_sum(F.col("pct")) / F.count("pct")).alias("out"))
    p = s.where(F.col("codec").isNull()).groupBy("job").agg(F.avg("pct").alias("pp"))
    since = s.groupBy("job").agg(F.min("started").alias("since"))
    out = v.join(p, "job", "full_outer").join(since, "job")
    total = F.when(F.col("vw").isNull(), F.col("pp")).when(F.col("pp").isNull(), F.col("vp") / F.col("vw")).otherwise((F.col("vp") + F.col("pp") * F.col("vw") * pipeline_share) / (F.col("vw") + F.col("vw") * pipeline_share))
    return out.select("job", rounded(total, 6).alias("progress"), rounded(F.col("out"), 6).alias("output_progress"), F.coalesce(F.when((total > 1) & (total < 99.5), (F.lit(now) - F.col("since")) * (100 - total) / total), F.lit(0.0)).alias("eta_s"))


def union_history(archived: DataFrame, current: DataFrame) -> DataFrame:
    """Archived and current stages as one sequence; missing columns are null."""
    return archived.withColumn("archived", F.lit(True)).unionByName(current.withColumn("archived", F.lit(False)), allowMissingColumns=True)


def plan_merge(stages: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned keys that have no row yet come as pending rows behind the last row that is not pending.

    stages: (job, key, pos, status); planned: (job, key, i) with i from 1. Rows that exist keep their state.
    """
    fresh = planned.join(stages, ["job", "key"], "left_anti")
    at = stages.groupBy("job").agg(F.max(F.when(F.col("status") != "pending", F.col("pos"))).alias("at"))
    n = F.count(F.lit(1)).over(W.partitionBy("job"))
    new = fresh.join(at, "job", "left").withColumn("pos", F.coalesce("at", F.lit(0)) + F.col("i") / (n + 1)).select("job", "key", "pos", F.lit("pending").alias("status"))
    return stages.select("job", "key", F.col("pos").cast("double").alias("pos"), "status").unionByName(new)


def first_and_last(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Per key the first value, the last, and the last that is not blank."""
    filled = F.when(F.coalesce(F.col(value), F.lit("")) != "", F.col(order))
    return df.groupBy(*key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max_by(value, filled).alias("last_filled"))
