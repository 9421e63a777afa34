"""Queries over costs, machines, ladders and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from encodelens.functions import scalars as S
from encodelens.operators import cost, fleet, ladders
from encodelens.operators.blocks import dealt
from encodelens.plans.registry import NOW, query

JOBS_NOW = 1_700_060_000


_REASON = "case seq % 7 when 0 then 'Host EC2 (instance i-1) terminated.' when 1 then 'Spot capacity WAS TERMINATED' when 2 then null else 'Essential container in task exited' end"


@query("O52_reclaim_rollup", f"""
with a as (select job, key, {_REASON} as reason, started, ended as stopped from stages),
r as (select job, key, count(*) filter (where starts_with(reason, 'Host EC2') or contains(lower(reason), 'was terminated')) as c,
        coalesce(sum(stopped - started) filter (where stopped > started and (starts_with(reason, 'Host EC2') or contains(lower(reason), 'was terminated'))), 0) as lost,
        coalesce(sum(case when stopped > started then stopped - started else {{now}} - started end) filter (where stopped > started or {{now}} > started), 0) as total from a group by all)
select job, sum(c)::bigint as reclaims, round(sum(lost)::double, 4) as lost_s, round(sum(total)::double, 4) as total_s, round(100 * sum(lost)::double / nullif(sum(total), 0), 4) as waste_pct from r group by job""")
def _(v):
    a = v.stages.select("job", "key", F.expr(_REASON).alias("reason"), "started", F.col("ended").alias("stopped"))
    return cost.reclaim_rollup(cost.attempt_reclaims(a, NOW))


@query("O53_stats_rollup", """
with l as (select job, file_index as exec, arg_max({'w': cpu_s, 'v': worker_s / 3601.7, 'j': peak_mib, 'l': percent, 's': key, 'm': height}, seq) as r from stages group by all),
a as (select job, round(sum(r.w), 4) as wall_s, round(sum(r.v), 4) as vcpu_h, sum(r.j)::bigint as jobs, max(r.l) as longest_s, max(r.m) as max_vcpus, max({'l': r.l, 's': r.s}).s as slowest from l group by job)
select *, round(vcpu_h * 3600 / nullif(wall_s, 0), 4) as concurrency, round(vcpu_h * 3600 / nullif(wall_s, 0) / max_vcpus, 4) as efficiency from a""")
def _(v):
    s = v.stages.select("job", F.col("file_index").alias("exec"), F.col("cpu_s").alias("wall_s"), (F.col("worker_s") / 3601.7).alias("vcpu_h"), F.col("peak_mib").alias("jobs"), F.col("percent").alias("longest_s"), F.col("key").alias("slowest"), F.col("height").alias("max_vcpus"), "seq")
    return cost.stats_rollup(s)


_PARTS = {"spot": "a", "ondemand": "a * 2.6", "saved": "a * 1.6", "egress_gb": "b / 90.1", "egress_usd": "b", "egress_avoided_gb": "c / 90.1", "sfn": "c", "request": "a / 9.7", "storage": "b / 9.7", "put_est": "c / 9.7"}


@query("O54_cost_rollup", f"""
with l as (select job, file_index as exec, arg_max(cpu_s, seq) as a, arg_max(worker_s, seq) as b, arg_max(percent, seq) as c from stages group by all),
t as (select job, count(*) as execs, {", ".join(f"round(sum({x}), 4) as {n}" for n, x in _PARTS.items())} from l group by job)
select *, round(spot + egress_usd + sfn + request + storage + put_est, 4) as total from t""")
def _(v):
    s = v.stages.selectExpr("job", "file_index as exec", "seq", "cpu_s as a", "worker_s as b", "percent as c")
    return cost.cost_rollup(s.selectExpr("job", "exec", "seq", *[f"{x} as {n}" for n, x in _PARTS.items()]))


RENTAL = """
with j as (select *, coalesce(stop_s, 1700060000) as stop from batch_jobs),
u0 as (select exec, instance, min(start_s) as first_job, max(stop) as last_job, count(*) as jobs, sum((stop - start_s) * vcpu)::bigint as alloc from j group by all),
box as (select instance, vcpu as box_vcpu, launch, coalesce(ended, 1700060000) as e from fleet
  union all select 1000000000 + r_regionkey, 4, 1700000000 + r_regionkey * 3600, 1700007200 + r_regionkey * 3600 from region),
u as (select u0.*, box_vcpu, launch, e from u0 join box using (instance)),
w as (select exec, min(launch) - 120 as lo, max(last_job) + 120 as hi from u group by exec),
x as (select w.exec, b.instance, b.box_vcpu, b.launch, b.e from box b join w on b.launch between w.lo and w.hi where b.instance not in (select instance from u)),
rent as (select exec, instance, jobs, box_vcpu, greatest(e - launch, 0) as life_s, greatest(first_job - launch, 0) as idle_before_s, greatest(e - last_job, 0) as idle_after_s, alloc as allocated_vcpu_s,
  greatest(e - launch, 0) * box_vcpu as rented_vcpu_s from u
union all select exec, instance, 0, box_vcpu, greatest(e - launch, 0), greatest(e - launch, 0), 0, 0, greatest(e - launch, 0) * box_vcpu from x)
"""


def boxes(v):
    """The fleet and a spare box in each region, which ran no job."""
    spare = v.region.selectExpr("1000000000 + r_regionkey as instance", "4 as vcpu", "1700000000 + r_regionkey * 3600 as launch", "1700007200 + r_regionkey * 3600 as ended")
    return v.fleet.select("instance", "vcpu", "launch", "ended").unionByName(spare)


@query("O56_machine_rental", RENTAL + "select * from rent")
def _(v):
    return cost.machine_rental(v.batch_jobs, boxes(v), JOBS_NOW)


@query("O40_rental_attribution", RENTAL + """
select exec, count(*) as boxes, count(*) filter (where jobs = 0) as unused, sum(rented_vcpu_s)::bigint as rented_vcpu_s, sum(allocated_vcpu_s)::bigint as allocated_vcpu_s,
       round(100 * (1 - sum(allocated_vcpu_s) / nullif(sum(rented_vcpu_s), 0)), 4) as unallocated_pct from rent group by exec""")
def _(v):
    return cost.rental_attribution(cost.rental_totals(v.batch_jobs, boxes(v), JOBS_NOW))


@query("O57_fleet_shape", RENTAL + """
, al as (select r.exec, f.vcpu, f.ended is null as alive, r.idle_before_s, r.idle_after_s from rent r join fleet f using (instance) where jobs > 0)
select exec, sum(vcpu)::bigint as fleet_vcpu, round(sum((idle_before_s + case when alive then 0 else idle_after_s end) * vcpu) / 3600.0, 4) as edge_vcpu_h from al group by exec""")
def _(v):
    j = v.batch_jobs.groupBy("exec", "instance").agg(F.min("start_s").alias("first_job"), F.max(F.coalesce("stop_s", F.lit(JOBS_NOW))).alias("last_job"))
    return cost.fleet_shape(j.join(v.fleet, "instance").select("exec", "vcpu", "launch", "first_job", "last_job", F.coalesce("ended", F.lit(JOBS_NOW)).alias("end"), F.col("ended").isNull().alias("alive")))


@query("O55_run_cost", RENTAL + """
, jj as (select exec, count(*) as jobs, max(stop_s) - min(start_s) as wall_s, max(stop_s - start_s) as longest_s, arg_max(job_id, {'l': stop_s - start_s, 'i': -job_id}) as slowest, sum((stop_s - start_s) * vcpu) as jv
  from batch_jobs where stop_s > start_s group by exec),
rr as (select exec, sum(rented_vcpu_s) as rented from rent group by exec),
tt as (select exec, sum(cpu_s * 1000370.3) as eb, count(*) * 1e9 as ab, sum(vcpu) as ef, sum(encode_s * 1e6) as sb, count(*) * 5 as tr from batch_jobs where cpu_s > 2000 group by exec),
m as (select jj.*, coalesce(rented, 0) > 0 as r, case when coalesce(rented, 0) > 0 then rented else jv end / 3600.0 as h, coalesce(eb, 0) / 1e9 as eg, coalesce(ab, 0) / 1e9 as ag, coalesce(tr, 0) / 1000 * 0.025 as sfn,
  coalesce(ef, 0) / 1000 * 0.0004 as rq, coalesce(sb, 0) / 1e9 * (wall_s / 3600.0) / 730 * 0.023 as st, coalesce(sb, 0) / 1e9 * 1897.0 / 1000 * 0.005 as pu from jj left join rr using (exec) left join tt using (exec))
select exec, jobs, wall_s, longest_s, slowest, case when r then 'rented' else 'allocated' end as basis, round(h, 4) as vcpu_h, round(h * 0.036, 4) as ondemand_usd, round(h * (0.036 - 0.014), 4) as saved_usd, round(eg, 4) as egress_gb, round(ag, 4) as egress_avoided_gb,
  round(h * 0.014, 6) as spot_usd, round(eg * 0.09, 6) as egress_usd, round(sfn, 6) as sfn_usd, round(rq, 6) as request_usd, round(st, 6) as storage_usd, round(pu, 6) as put_est_usd, round(h * 0.014 + eg * 0.09 + sfn + rq + st + pu, 4) as total_usd from m""")
def _(v):
    j = v.batch_jobs.where("cpu_s > 2000").groupBy("exec").agg(F.sum(F.col("cpu_s") * 1000370.3).alias("egress_bytes"), (F.count(F.lit(1)) * 1e9).alias("avoided_bytes"), F.sum("vcpu").alias("egress_files"), F.sum(F.col("encode_s") * 1e6).alias("staged_bytes"), (F.count(F.lit(1)) * 5).alias("transitions"))
    return cost.run_cost(v.batch_jobs, cost.rental_totals(v.batch_jobs, boxes(v), JOBS_NOW), j)


@query("O62_cpu_by_tier", """
with t as (select codec, height, count(*) as jobs, avg(cpu_s) / nullif(avg(encode_s), 0) as cores, case when codec = 'h264' then case when height <= 594 then 4 when height <= 1080 then 3 else 2 end when height <= 540 or codec = 'hevc' then 2 when codec = 'av1' then 8 else 4 end as vcpu from batch_jobs group by codec, height)
select codec, height, jobs, round(cores, 4) as cores, vcpu, round(100 * cores / vcpu, 4) as used_pct, 100 * cores / vcpu < 60 as low from t""")
def _(v):
    reserved = v.batch_jobs.select("codec", "height").distinct().withColumn("vcpu", S.vcpu_for(F.col("codec"), F.col("height")))
    return cost.cpu_by_tier(v.batch_jobs, reserved)


@query("O63_timing_cold_warm", """
with j as (select codec, instance, stop_s - start_s as r, row_number() over (partition by instance order by start_s, job_id) = 1 as cold from batch_jobs where stop_s is not null)
select codec, count(*) filter (where cold) as cold_jobs, round(avg(r) filter (where cold), 1) as cold_s, count(*) filter (where not cold) as warm_jobs, round(avg(r) filter (where not cold), 1) as warm_s from j group by codec""")
def _(v):
    return cost.timing_cold_warm(v.batch_jobs)


@query("O64_thread_load", """
with s as (select *, split_part(key, ':', 2) as codec from stages where key like 'encode:%'),
w as (select codec, max(ended) - min(started) as wall from s where started is not null and ended is not null group by codec),
t as (select codec, file_index, key, job % 97 as run, arg_max({'e': case when seq % 11 = 0 then 0 else worker_s end, 'c': cpu_s}, seq) as x from s group by all),
k as (select codec, x.c / x.e as r, row_number() over (partition by codec order by x.c / x.e) - 1 as i, count(*) over (partition by codec) as n from t where x.e > 0),
m as (select codec, max(r) filter (where i = least(n - 1, floor(n * 0.1))) as p10, max(r) filter (where i = least(n - 1, floor(n * 0.5))) as p50, max(r) filter (where i = least(n - 1, floor(n * 0.9))) as p90 from k group by codec)
select codec, count(*) as n, round(sum(x.c) / any_value(wall), 4) as load, round(sum(x.e) / any_value(wall), 4) as concurrency, round(any_value(p10), 4) as p10, round(any_value(p50), 4) as p50, round(any_value(p90), 4) as p90
from t join w using (codec) left join m using (codec) group by codec""")
def _(v):
    """The last timing of each key of a run; some runs time a key several times, and some timings have no encode seconds."""
    s = v.stages.withColumn("codec", S.stage_codec("key")).where("codec is not null")
    key = F.concat_ws("/", F.col("job") % 97, "file_index", "key")
    return cost.thread_load(s, s.select("codec", key.alias("key"), "seq", F.when(F.col("seq") % 11 == 0, 0).otherwise(F.col("worker_s")).alias("encode_s"), "cpu_s"))


@query("O41_run_overlap_exclude", """
with s as (select run, account, started_at, ended_at, ended_at > started_at as has from run_samples)
select a.run, a.account, a.has and exists (select 1 from s b where b.account = a.account and b.run <> a.run and b.has and b.started_at < a.ended_at and a.started_at < b.ended_at) as overlaps from s a""")
def _(v):
    return cost.overlapping_runs(v.run_samples).select("run", "account", "overlaps")


@query("O65_overhead_model", """
with s0 as (select *, concat('a', run // 4) as acc, ended_at > started_at as has from run_samples),
s as (select a.*, edge * 3600 / fleet_vcpu as edge_s, case when machine > edge then allocated / (machine - edge) end as packing from s0 a
  where fleet_vcpu > 0 and not (a.has and exists (select 1 from s0 b where b.acc = a.acc and b.run <> a.run and b.has and b.started_at < a.ended_at and a.started_at < b.ended_at))),
e as (select acc, median(edge_s) as v, count(*) as n from (select *, row_number() over (partition by acc order by started_at desc, run desc) as rn from s where edge_s > 0) where rn <= 10 group by acc),
p as (select acc, median(packing) as v, count(*) as n from (select *, row_number() over (partition by acc order by started_at desc, run desc) as rn from s where packing > 0) where rn <= 10 group by acc)
select a.acc as account, round(coalesce(e.v, 116), 4) as edge_s, round(least(greatest(coalesce(p.v, 0.91), 0.25), 1), 4) as packing, coalesce(e.n, 0) as n_edge, coalesce(p.n, 0) as n_packing
from (select distinct acc from s0) a left join e using (acc) left join p using (acc)""")
def _(v):
    return cost.overhead_model(v.run_samples.withColumn("account", F.concat(F.lit("a"), F.expr("run div 4"))))


@query("O66_spot_savings", """
select account, round(sum(saved_usd), 4) as saved_usd, round(coalesce(sum(saved_usd) filter (where ended_at between 900000000 - 86400 and 900000000), 0), 4) as saved_day_usd,
       round(sum(lost_s) / 60, 4) as lost_min, round(100 * sum(lost_s) / nullif(sum(total_s), 0), 4) as waste_pct from run_samples group by account""")
def _(v):
    return cost.spot_savings(v.run_samples, 900_000_000)


@query("O18_append_capped_log", """
select run, account from (select *, row_number() over (partition by account order by started_at desc, run desc) as rn from run_samples) where rn <= 50""")
def _(v):
    r = v.run_samples
    return cost.append_capped(r.where("run % 2 = 0"), r.where("run % 2 = 1"), "account", ["started_at", "run"], 50).select("run", "account")


@query("O19_merge_store", """
with k as (select clip, codec, reference, height, kbps, vmaf, case when kbps % 200 = 0 then vmaf + 1 end as fresh from curves)
select clip, codec, reference, height, kbps, coalesce(fresh, vmaf) as vmaf from k""")
def _(v):
    c = v.curves
    return cost.merge_store(c, c.where("kbps % 200 = 0").withColumn("vmaf", F.col("vmaf") + 1), ["clip", "codec", "reference", "height", "kbps"])


# ---- ladders

LABELED = """
with l as (select *, concat(height, 'p', case when count(*) over (partition by ladder, codec, height) > 1
  then concat('_', row_number() over (partition by ladder, codec, height order by pos)) else '' end) as label from rungs)
"""


@query("O26_resolve_rungs", """
with r as (select * from rungs where codec <> 'av1' union all select ladder, 'av1', pos, width, height, kbps from rungs where codec = 'hevc'),
q as (select request, ladder, case request % 4 when 0 then 0 when 1 then null else src_width end as src_width from requests),
""" + LABELED.strip().removeprefix("with ").replace("from rungs", "from r") + """
select request, l.ladder, codec, pos, width, height, case height when 720 then 3000 else kbps end as kbps, label, src_width
from l join q using (ladder) where height between 360 and 1440 and (coalesce(src_width, 0) <= 0 or width <= src_width)""")
def _(v):
    """All requests, of which some do not know their source's width."""
    width = F.when(F.col("request") % 4 == 0, 0).when(F.col("request") % 4 != 1, F.col("src_width"))
    q = v.requests.select("request", "ladder", width.alias("src_width"))
    return ladders.resolve_rungs(ladders.codec_ladders(v.rungs), q, 360, 1440, {720: 3000}).select("request", "ladder", "codec", "pos", "width", "height", "kbps", "label", "src_width")


@query("O27_band_gate", """
with a as (select ladder, concat(codec, '-', height) as codec, min(height) as lowest, max(height) as highest, count(*) filter (where height between 400 and 700) as n from rungs group by all)
select ladder, codec, lowest, highest, case when lowest > 700 then 'all above the band' when highest < 400 then 'all below the band' else 'none within the band' end as reason from a where n = 0""")
def _(v):
    return ladders.band_gate(v.rungs.withColumn("codec", F.concat_ws("-", "codec", "height")), 400, 700)


@query("O28_ladder_constraints", """
with r as (select ladder, codec, pos, kbps - 2000 as kbps from rungs)
select ladder, codec, pos, 'rate' as rule from r where kbps <= 0
union all select ladder, codec, pos, 'passes' from r where pos % 4 in (0, 3)
union all select ladder, codec, pos, 'extra_args' from r where pos % 5 = 0""")
def _(v):
    args = F.when(F.col("pos") % 5 == 0, "-x264-params a=1; rm").when(F.col("pos") % 5 == 1, "-tune film")
    return ladders.ladder_constraints(v.rungs.withColumn("kbps", F.col("kbps") - 2000).withColumn("passes", F.col("pos") % 4).withColumn("extra_args", args))


_RATES = ", ".join(f"('{a}', '{b}', {c}, {d}, {e!r}::double)" for a, b, c, d, e in ladders.RATES)
RATED = f"""
with rt(vendor, rate_codec, lo, hi, usd) as (values {_RATES}),
tr as (select r.*, vendor, arg_max(usd, case when rate_codec = codec then 1 else 0 end) as usd_min from rungs r join rt on height > lo and height <= hi and (rate_codec = codec or rate_codec = 'h264') group by all)
"""


@query("O45_tier_rate_join", RATED + "select ladder, codec, pos, width, height, kbps, vendor, usd_min from tr")
def _(v):
    return ladders.tier_rates(v.rungs, ladders.rates(v.spark))


JOINED = """
, rq as (select q.request, q.duration, q.fps, q.two_pass, q.src_mbps, q.has_audio, q.ladder, r.codec, r.pos, r.width, r.height, r.kbps from requests q join rungs r using (ladder) where r.width <= q.src_width)
"""


QUOTES = """
, t as (select q.request, q.duration, q.fps, q.two_pass, q.src_mbps, q.has_audio, tr.vendor, tr.usd_min from rq q join tr using (ladder, codec, pos)),
s as (select request, duration, has_audio, vendor, sum(usd_min * case when vendor = 'commercial' then greatest(ceil(fps / 30), 1) * case when src_mbps > 50 then 1 + 0.25 * ceil((src_mbps - 50) / 50) else 1 end
        when vendor = 'mediaconvert' and fps > 30 then 2 when vendor = 'bitmovin' and two_pass then 1.25 else 1 end + case when vendor = 'commercial' then 0.003 else 0 end) as a, count(*) as rungs from t group by all),
quotes as (select request, vendor, rungs, round((a + case when not has_audio then 0 when vendor = 'commercial' then 0.001 when vendor = 'coconut' then 0.00325 else 0 end) * duration / 60, 4) as usd from s)
"""


def grouped(v):
    """Requests with the sizes of their ladders, for figures that are summed over rungs."""
    return ladders.for_requests(ladders.rung_groups(v.rungs), v.requests)


@query("O72_saas_quote", RATED + JOINED + QUOTES + "select * from quotes")
def _(v):
    return ladders.saas_quote(grouped(v), ladders.rates(v.spark))


LEARNED = """
, le0 as (select case when l_suppkey % 4 = 0 then 'graviton' else concat('mac', l_suppkey % 3) end as machine,
    case l_returnflag when 'A' then 'h264' when 'N' then 'hevc' else 'av1' end as codec,
    case l_linenumber when 1 then 234 when 2 then 360 when 3 then 432 when 4 then 540 when 5 then 720 when 6 then 1080 else 2160 end as height,
    l_quantity / 25 as speed, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey as seq from lineitem),
le1 as (select *, row_number() over (partition by machine, codec, height order by seq, speed) as rn, count(*) over (partition by machine, codec, height) as n from le0),
le as (select machine, codec, height, round(sum(speed * case when rn = 1 then power(0.7, n - 1) else 0.3 * power(0.7, n - rn) end), 6) as speed, count(*) as n from le1 group by all)
"""
#: Rungs with the seed speed of the base machine, virtual CPUs, and what the cloud's machine (sp) and the local ones (ls) have learned.
SPEED = """
, sd as (select q.*, case q.codec when 'h264' then 1.5 when 'av1' then 0.1 else 0.14 end * 1080 * 1080 / (q.height * q.height) * 1.0 * 30 / q.fps * case when two_pass then 0.5 else 1 end as seed,
  VCPU as vcpu from rq q),
sp as (select q.*, coalesce(l.speed, greatest(seed * 0.7, 0.001)) as speed, coalesce(l.n, 0) as learned_n from sd q left join le l on l.machine = 'graviton' and l.codec = q.codec and l.height = q.height),
lm as (select codec, height, avg(speed) as speed, count(*) as n from le where machine <> 'graviton' group by all),
ls as (select q.*, coalesce(l.speed, greatest(seed, 0.001)) as speed, coalesce(l.n, 0) as learned_n from sd q left join lm l on l.codec = q.codec and l.height = q.height)
""".replace("VCPU", "case when q.codec = 'h264' then case when q.height <= 594 then 4 when q.height <= 1080 then 3 else 2 end when q.height <= 540 or q.codec = 'hevc' then 2 when q.codec = 'av1' then 8 else 4 end")


def speed_samples(v):
    m = F.when(F.col("l_suppkey") % 4 == 0, ladders.CLOUD_MACHINE).otherwise(F.concat(F.lit("mac"), F.col("l_suppkey") % 3))
    codec, height = F.expr("case l_returnflag when 'A' then 'h264' when 'N' then 'hevc' else 'av1' end"), F.expr("case l_linenumber when 1 then 234 when 2 then 360 when 3 then 432 when 4 then 540 when 5 then 720 when 6 then 1080 else 2160 end")
    return v.lineitem.select(m.alias("machine"), codec.alias("codec"), height.alias("height"), (F.col("l_quantity") / 25).alias("speed"), F.expr("(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey").alias("seq"))


def learned(v):
    return fleet.speed_ewma(speed_samples(v), digits=6)


def requested(v, speeds=None):
    return ladders.with_speed(grouped(v), speeds or learned(v), ladders.CLOUD_MACHINE)


def requested_locally(v, speeds=None):
    return ladders.with_local_speed(grouped(v), speeds or learned(v))


_W = "with nothing as (select 1)"


@query("O81_speed_ewma", _W + LEARNED + "select * from le")
def _(v):
    return learned(v)


@query("O67_speed_lookup", _W + LEARNED + """
select codec, height, round(avg(speed), 4) as mean, round(avg(speed) filter (where machine <> 'graviton'), 4) as local_mean, round(min(speed) filter (where machine <> 'graviton'), 4) as local_slowest, sum(n)::bigint as n from le group by all""")
def _(v):
    return ladders.speed_lookup(learned(v))


QUOTE = _W + JOINED + LEARNED + SPEED


CLOUD = """
, a as (select request, duration, sum(duration / speed * vcpu / 3600) as alloc, sum(vcpu)::bigint as wave, sum(kbps * duration * 1000 / 8 / 1e9) as gb from sp group by all),
m as (select *, least(wave, 48) as fleet_vcpu, alloc / 0.91 + least(wave, 48) * 116.0 / 3600 as machine from a),
cloud as (select request, fleet_vcpu, round(alloc, 4) as allocated_vcpu_h, round(machine, 4) as machine_vcpu_h, round(machine * 0.014, 4) as spot_usd, round(machine * 0.036, 4) as ondemand_usd,
       round(least(greatest(1 - alloc / machine, 0), 0.85), 4) as idle, round(gb, 4) as output_gb, round(gb * 0.09, 4) as egress_usd from m)
"""
LOCAL = """
, local as (select request, round(greatest(sum(duration / speed * vcpu) / 16, max(least(duration / speed, 240))), 4) as wall_s, count(*) filter (where learned_n > 0) as learned, count(*) as rungs from ls group by request)
"""


@query("O73_cloud_quote", QUOTE + CLOUD + "select * from cloud")
def _(v):
    return ladders.cloud_quote(requested(v))


_FILES = {
    "request": "l_suppkey", "pos": "l_orderkey * 10 + l_linenumber", "duration": "cast(l_quantity as double) * 1.7531 - 8.7655", "width": "case l_linenumber when 1 then 0 when 2 then 1280 when 3 then 1920 else 3840 end",
    "fps": "case l_returnflag when 'A' then 24 when 'N' then 30 else 60 end", "limit_s": "case l_suppkey % 4 when 0 then '20.537' when 1 then 'all' when 2 then '' end",
}


@query("O73_batch_quote", _W + f"""
, files as (select {", ".join(f"{x} as {n}" for n, x in _FILES.items())} from lineitem),
b as (select request, sum(duration) filter (where duration > 0) as total, count(*) as files, max(try_cast(limit_s as double)) as lim,
  coalesce(arg_min(width, pos) filter (where duration > 0 and width > 0), 0) as src_width from files group by request),
batch as (select r.* replace (least(total, case when lim > 0 then lim * files end) as duration, b.src_width as src_width), files from requests r join b using (request) where total > 0)
""" + JOINED.replace("requests q", "batch q").replace("r.width <= q.src_width", "q.src_width <= 0 or r.width <= q.src_width") + LEARNED + SPEED + CLOUD + "select cloud.*, batch.files, round(batch.duration, 4) as duration from cloud join batch using (request)")
def _(v):
    batch = ladders.batch_source(v.lineitem.selectExpr(*[f"{x} as {n}" for n, x in _FILES.items()]))
    asked = v.requests.drop("duration", "src_width").join(batch.drop("fps"), "request")
    rungs = ladders.with_speed(ladders.for_requests(ladders.rung_groups(v.rungs), asked), learned(v), ladders.CLOUD_MACHINE)
    return ladders.cloud_quote(rungs).join(asked.select("request", "files", F.round("duration", 4).alias("duration")), "request")


@query("O75_local_makespan", QUOTE + LOCAL + "select * from local")
def _(v):
    return ladders.local_makespan(requested_locally(v))


@query("O87_predicted_wall_rank", QUOTE + """
select request, codec, pos, height, round(duration / speed, 4) as wall_s, row_number() over (partition by request order by round(duration / speed, 6) desc, codec = 'hevc' desc, pos) as rank from sp""")
def _(v):
    return ladders.predicted_wall_rank(requested(v), v.rungs)


@query("O131_estimate_rows", RATED + JOINED + QUOTES + LEARNED + SPEED + CLOUD + LOCAL + """
, p as (select request, max(usd) filter (where vendor = 'commercial') as commercial_usd, max(usd) filter (where vendor = 'mediaconvert') as mediaconvert_usd,
  max(usd) filter (where vendor = 'coconut') as coconut_usd, max(usd) filter (where vendor = 'bitmovin') as bitmovin_usd from quotes group by request)
select r.request, r.local, spot_usd, ondemand_usd, round(100 * idle, 4) as idle_pct, output_gb as egress_gb, egress_usd, case when r.local then 0.0 else round(spot_usd + egress_usd, 4) end::double as total_usd,
  commercial_usd, mediaconvert_usd, coconut_usd, bitmovin_usd, wall_s as local_wall_s, learned as local_wall_learned, l.rungs as local_wall_rungs
from requests r left join cloud using (request) left join local l using (request) left join p using (request)""")
def _(v):
    quotes = ladders.saas_quote(grouped(v), ladders.rates(v.spark))
    speeds = learned(v)
    return ladders.estimate_rows(v.requests, quotes, ladders.cloud_quote(requested(v, speeds)), ladders.local_makespan(requested_locally(v, speeds)))


PLAN = """
with q as (select request, duration, case plan when 0 then 30 when 1 then 12.5 else 100 end::double as chunk, case plan when 0 then 6 when 1 then 4 else 5 end::double as segment from requests),
g as (select *, case segment when 6 then 6 when 4 then 12 else 30 end::double as grid from q),
u as (select *, greatest(ceil(duration / grid - 1e-6), 1)::bigint as units from g),
n as (select *, least(greatest(ceil(duration / chunk - 1e-6), 1)::bigint, units) as n from u),
c as (select *, unnest(range(0, n)) as i from n),
t as (select *, grid * (i * (units // n) + least(i, units % n)) as start from c),
z as (select *, n > 1 and duration - grid * ((n - 1) * (units // n) + least(n - 1, units % n)) < 2 as runt from t),
k as (select *, n - case when runt then 1 else 0 end as m from z)
"""


def planned(v):
    pick = lambda a, b, c: F.when(F.col("plan") == 0, a).when(F.col("plan") == 1, b).otherwise(c)
    return v.requests.select("request", "duration", pick(30.0, 12.5, 100.0).alias("chunk"), pick(6.0, 4.0, 5.0).alias("segment"))


@query("O84_chunk_plan", PLAN + """
select request, duration, chunk, segment, i::int as "index", round(start, 4) as start,
       round(case when i = m - 1 then duration else grid * ((i + 1) * (units // n) + least(i + 1, units % n)) end - start, 4) as length,
       abs(chunk / segment - round(chunk / segment)) < 1e-6 as aligned from k where i < m""")
def _(v):
    return ladders.chunk_plan(planned(v))


@query("O85_chunk_size", """
select request, plan, case plan when 0 then duration else least(case plan when 1 then greatest(240, 12) else greatest(round(240 * fps / 40.0 / 12), 1) * 12 end, duration) end as chunk_s from requests""")
def _(v):
    mode = F.when(F.col("plan") == 0, "whole").when(F.col("plan") == 1, "fixed").otherwise("dynamic")
    return v.requests.select("request", "plan", ladders.chunk_size(F.lit(240.0), F.col("fps") / 40.0, F.col("duration"), mode).alias("chunk_s"))


def _chunks(target: str) -> str:
    """SQL: the chunks that rung group x of a clip plans at a target."""
    units = "greatest(ceil(duration / 6 - 1e-6), 1)::bigint"
    n = f"least(greatest(ceil(duration / least(greatest(round({target} * x.s / 12), 1) * 12, duration) - 1e-6), 1)::bigint, {units})"
    return f"list_sum(list_transform(r, lambda x: x.n * ({n} - case when {n} > 1 and duration - 6.0 * (({n} - 1) * ({units} // {n}) + least({n} - 1, {units} % {n})) < 2 then 1 else 0 end)))::bigint"


@query("O74_chunk_budget_sweep", QUOTE.replace("with ", "with recursive ", 1) + f"""
, g as (select request, duration, list({{'s': speed, 'n': n}}) as r from (select request, duration, speed, count(*) as n from sp group by all) group by request, duration),
tries as (select request, duration, r, t, {_chunks("t")} as n from g, (select 240.0 * 2 ** k as t from (select unnest(range(0, 13)) as k))),
found as (select request, duration, r, arg_min(n, t) as before, coalesce(min(t) filter (where n <= 60), 983040.0) as hi, count(*) filter (where n <= 60) > 0 as fits from tries group by request, duration, r),
b as (select request, duration, r, hi / 2 as lo, hi from found where fits and hi > 240
  union all select request, duration, r, case when {_chunks("((lo + hi) / 2)")} <= 60 then lo else (lo + hi) / 2 end, case when {_chunks("((lo + hi) / 2)")} <= 60 then (lo + hi) / 2 else hi end from b where hi - lo > 1),
e as (select request, min(hi) as hi from b group by request), t as (select f.request, f.duration, f.r, f.before, coalesce(e.hi, f.hi) as target from found f left join e using (request))
select request, before, round(target, 6) as target, {_chunks("target")} as after from t""")
def _(v):
    return ladders.chunk_budget_sweep(requested(v), budget=60)


_TRIES = ", ".join(f"sum((select count(*) from range(0, greatest(ceil(d / 6 - 1e-6), 1)::bigint) u(x) where x < least(ceil(d / {s} - 1e-6), ceil(d / 6 - 1e-6))) - case when ceil(d / {s} - 1e-6) > 1 and d - t{s} < 2 then 1 else 0 end) as n{s}" for s in ladders.ADVISED_S)
_N = "least(ceil(d / {s} - 1e-6), units)::bigint"
_TAIL = ", ".join("6.0 * ((N - 1) * (units // N) + least(N - 1, units % N)) as tS".replace("N", _N.replace("{s}", str(s))).replace("tS", f"t{s}") for s in ladders.ADVISED_S)


@query("O74_plan_fit", QUOTE + f"""
, f as (select request, codec, pos, vcpu, duration * 40.253 as d, case request % 3 when 0 then 12 when 1 then 30 else 90 end::double as c from sp),
u as (select *, ceil(d / 6 - 1e-6)::bigint as units, least(ceil(d / c - 1e-6), ceil(d / 6 - 1e-6))::bigint as n0 from f),
n as (select *, units // n0 as base, units % n0 as extra, n0 - case when n0 > 1 and d - 6.0 * ((n0 - 1) * (units // n0) + least(n0 - 1, units % n0)) < 2 then 1 else 0 end as n from u),
i as (select *, unnest(range(0, n)) as i from n),
s as (select request, codec, pos, n, vcpu, i, 6.0 * (i * base + least(i, extra)) as st, case when i = n - 1 then d else 6.0 * ((i + 1) * base + least(i + 1, extra)) end as en from i),
j as (select request, codec, pos, n, vcpu, length(concat('[', string_agg(printf('{{"index":%d,"start_s":"%.6f","duration_s":"%.6f"}}', i, st, en - st), ','), ']')) as bytes from s group by all),
a as (select request, sum(n)::bigint as chunks, sum(bytes)::bigint as bytes, sum(n * vcpu)::bigint as peak_vcpu from j group by request),
tl as (select *, {_TAIL} from u), tr as (select request, {_TRIES} from tl group by request)
select request, chunks, chunks * 8 as events, bytes, peak_vcpu, case when chunks * 8 > 25000 and bytes > 209715 then 'history and input' when chunks * 8 > 25000 then 'history' when bytes > 209715 then 'input' end as fails,
  case {" ".join(f"when n{s} * 8 <= 25000 then {s}" for s in ladders.ADVISED_S)} end as advice_s from a join tr using (request)""")
def _(v):
    """Plans of fixed chunk lengths for clips of up to half a day."""
    chunk = F.when(F.col("request") % 3 == 0, 12.0).when(F.col("request") % 3 == 1, 30.0).otherwise(90.0)
    return ladders.plan_fit(requested(v).withColumn("duration", F.col("duration") * 40.253).withColumn("chunk", chunk))


@query("O86_decode_bands", """
with recursive r as (select ladder, codec, pos, height, width * height / 1e6 as mp, row_number() over (partition by ladder, codec order by width * height / 1e6, pos) as i from rungs where height <= 1080),
b as (select ladder, codec, pos, height, mp, i, 0 as band, mp as used from r where i = 1
  union all select r.ladder, r.codec, r.pos, r.height, r.mp, r.i, case when used + r.mp > 4.0 then band + 1 else band end, case when used + r.mp > 4.0 then r.mp else used + r.mp end
  from b join r on r.ladder = b.ladder and r.codec = b.codec and r.i = b.i + 1),
n as (select *, count(*) over (partition by ladder, codec, band) as size, row_number() over (partition by ladder, codec, band order by mp desc, pos) as rn from b)
select ladder, codec, band, pos, height, size, rn as "at" from n where size > 1""")
def _(v):
    return ladders.decode_bands(v.rungs)


@query("O89_price_scalars", """
select job_id, greatest(cpu_s * 1e6, 0) / 1e9 * 0.09 as egress, vcpu / 1000 * 0.005 + cpu_s / 1000 * 0.0004 as requests, cpu_s * encode_s / 730 * 0.023 as storage,
       vcpu / 1000 * 0.025 as transitions, cpu_s / 1e6 * case when vcpu = 2 then 0.5 else 0.4 end as queue, encode_s * 1897.0 / 1000 * 0.005 as puts from batch_jobs""")
def _(v):
    c, e, n = F.col("cpu_s"), F.col("encode_s"), F.col("vcpu")
    return v.batch_jobs.select("job_id", S.egress_usd(c * 1e6).alias("egress"), S.request_usd(n, c).alias("requests"), S.storage_usd(c, e).alias("storage"), S.transitions_usd(n).alias("transitions"), S.queue_usd(c, n == 2).alias("queue"), S.put_estimate_usd(e).alias("puts"))


@query("O91_speed_key_seed", JOINED.replace(", rq", "with rq") + """
select request, pos, concat_ws(':', 'local', codec, height, case when two_pass then '2' else '1' end, 'medium', fps) as key,
       round(greatest(case codec when 'h264' then 1.5 when 'av1' then 0.1 else 0.14 end * 1080 * 1080 / (height * height) * 0.5 * 30 / fps * case when two_pass then 0.5 else 1 end * 0.7, 0.001) * 0.9973, 9) as seed from rq""")
def _(v):
    """Key and seed are found once for a rung and a set of requests that agree in all that they depend on."""
    args = (F.col("codec"), F.col("height"), F.col("two_pass"))
    key, seed = S.speed_key(F.lit(""), *args, F.lit(None).cast("string"), F.col("fps")), F.round(S.seed_speed(*args, F.lit("slow"), F.col("fps"), F.lit("graviton")) * 0.9973, 9)
    same = ("ladder", "src_width", "fps", "two_pass")
    return ladders.all_pairs(v.rungs, v.requests.select("request", *same), same=same, once={"key": key, "seed": seed}).select("request", "pos", "key", "seed")


@query("O92_reservations", """
with t(codec, lo, hi, vcpu, memory) as (values ('h264', 0, 594, 4, 2048), ('h264', 594, 1080, 3, 2048), ('h264', 1080, 9999, 2, 3072), ('hevc', 0, 1080, 2, 3072),
  ('hevc', 1080, 9999, 2, 6144), ('av1', 0, 540, 2, 3072), ('av1', 540, 9999, 8, 6144), ('vp9', 0, 540, 2, 3072), ('vp9', 540, 1080, 4, 3072), ('vp9', 1080, 9999, 4, 6144)),
r as (select distinct case when pos % 17 = 0 then 'vp9' else codec end as codec, height from rungs)
select r.codec, r.height, vcpu, memory from r join t on t.codec = r.codec and r.height > lo and r.height <= hi""")
def _(v):
    codec = F.when(F.col("pos") % 17 == 0, "vp9").otherwise(F.col("codec")).alias("codec")
    r = v.rungs.select(codec, "height").distinct()
    return r.select("codec", "height", S.vcpu_for(F.col("codec"), F.col("height")).alias("vcpu"), S.memory_for(F.col("codec"), F.col("height")).alias("memory"))


@query("O93_multipliers", """
select request, greatest(ceil(fps / 30), 1)::bigint as fps_mult, case when duration / 5 > 50 then 1 + 0.25 * ceil((duration / 5 - 50) / 50) else 1.0 end::double as rate_mult from requests""")
def _(v):
    return v.requests.select("request", S.fps_mult(F.col("fps")).cast("long").alias("fps_mult"), S.bitrate_mult(F.col("duration") / 5).cast("double").alias("rate_mult"))


@query("O94_padding_keyint_snap", """
select request, greatest(round_even(fps * (1 + plan * 0.5), 0), 1)::int as keyint, greatest(round(duration / 6.0), 1) * 6.0 as snapped, lcm(6000, fps * 100)::bigint as grid_ms,
       case when (duration * 1000)::bigint % lcm(6000, fps * 100) <= 500 then 0 else lcm(6000, fps * 100) - (duration * 1000)::bigint % lcm(6000, fps * 100) end::bigint as pad_ms from (select * replace (floor(duration) as duration) from requests)""")
def _(v):
    q = v.requests.withColumn("duration", F.floor("duration").cast("double")).withColumn("g", S.lcm(F.lit(6000), F.col("fps") * 100))
    pad = S.padding((F.col("duration") * 1000).cast("long"), F.col("g"))
    return q.select("request", S.keyint(F.col("fps"), 1 + F.col("plan") * 0.5).alias("keyint"), S.snap(F.col("duration"), F.lit(6.0)).alias("snapped"), F.col("g").alias("grid_ms"), pad.alias("pad_ms"))


@query("O90_argv_normalize", """
select concat(codec, height) as rung, concat('-y -i <PATH> -c:v ', codec, ' -r 30000/1001 -vf scale=1280:720/2 -b:v ', kbps, 'k -ss <PATH> -nostats <PATH>') as settings, count(*) as n from rungs group by all""")
def _(v):
    words = lambda text: [F.lit(x) for x in text.split()]
    argv = F.array(*words("-y -i"), F.concat(F.lit("in"), F.col("pos")), F.lit("-c:v"), F.col("codec"), *words("-r 30000/1001 -vf scale=1280:720/2 -b:v"), F.concat("kbps", F.lit("k")), F.lit("-ss"), F.col("pos").cast("string"), *words("-nostats -progress pipe:1 -stats_period"), F.col("pos").cast("string"), F.concat(F.lit("s3://out/"), F.col("pos")))
    r = dealt(v.rungs, "pos", rows_a_task=1 << 15)  # a small file is one task's, its command lines are not
    return r.select(F.concat("codec", "height").alias("rung"), S.normalize_argv(argv).alias("settings")).groupBy("rung", "settings").agg(F.count(F.lit(1)).alias("n"))


@query("O95_dims_and_names", r"""
select output, regexp_replace(name, '_\d{8}(_\d{6})?$', '') as base, regexp_matches(name, '_\d{8}(_\d{6})?$') as backup,
       case when length(name) <= 12 then name else concat(substr(name, 1, 8), right(name, 4)) end as short,
       case when h <= 1080 then w - w % 2 else round_even(w * 1080 / h, 0)::int - round_even(w * 1080 / h, 0)::int % 2 end::int as width, least(h - h % 2, 1080)::int as height,
       case when least(h, 1440) >= 1440 then 'vmaf_4k_v0.6.1' else 'vmaf_v0.6.1' end as model,
       case output % 4 when 0 then 1 when 1 then 96 when 2 then 0 else 64 end as vcpus
from (select *, (bytes % 3841)::int as w, (100 + bytes % 2060)::int as h from outputs)""")
def _(v):
    o = v.outputs.withColumn("w", (F.col("bytes") % 3841).cast("int")).withColumn("h", (100 + F.col("bytes") % 2060).cast("int"))
    width, height = S.compare_dims(F.col("w"), F.col("h"), 1080)
    kind = F.element_at(F.array(*map(F.lit, ("c7g.medium", "m7g.24xlarge", "plain", "r6.metal"))), (F.col("output") % 4 + 1).cast("int"))
    return o.select("output", S.backup_base("name").alias("base"), S.is_backup("name").alias("backup"), S.trim_name("name", 12, 4).alias("short"), width.alias("width"), height.alias("height"), S.quality_model(F.least("h", F.lit(1440))).alias("model"), S.instance_vcpus(kind).alias("vcpus"))
