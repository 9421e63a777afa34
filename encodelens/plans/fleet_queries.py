"""Queries over machines, inventories and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from encodelens.functions import scalars as S
from encodelens.operators import fleet, retention
from encodelens.plans.registry import NOW, query

T = 1_700_010_000
J = 1_706_500_000


@query("O29_output_state", """
with o as (select *, expires_at = '2024-03-01T00:00:00Z' and {now} > 1709251200 as expired from outputs)
select output, case when gone then 'gone' when expired then 'expired' else 'available' end as state, not gone and not expired and s3_prefix <> '' as packageable, gone and not sidecar as unrecoverable from o""")
def _(v):
    return retention.output_state(v.outputs, NOW).select("output", "state", "packageable", "unrecoverable")


@query("O30_vmaf_state", """
select output, case when output % 6 = 0 then 'done' when output % 6 = 1 then 'failed' when gone then 'ineligible' else 'pending' end as vmaf_state from outputs""")
def _(v):
    o = v.outputs.withColumn("scores", F.when(F.col("output") % 6 == 0, 3).otherwise(0)).withColumn("failed", F.col("output") % 6 == 1).withColumn("eligible", ~F.col("gone"))
    return retention.vmaf_state(o).select("output", "vmaf_state")


_SCORES = """select job % 500 as output, codec, concat(label, case when chunk % 3 = 0 then '' when chunk % 3 = 1 then '_1' else '_2' end) as label, max(mean) as mean, max(case when chunk % 5 = 0 then 'vmaf_v0.6.1' end) as model,
  max(case when chunk % 5 = 0 then 1080 end) as common_height from vmaf_parts group by job % 500, codec, label, chunk % 3"""


@query("O30_rung_scores", f"""
with s as ({_SCORES.replace("chunk % 3 = 0", "(chunk % 3) = 0")}),
r as (select distinct s.output, s.codec, h.h as height from s, (values (234), (360), (540), (2160)) h(h)),
m as (select output, codec, arg_min(model, label) filter (where model is not null) as model, arg_min(common_height, label) filter (where model is not null) as common_height from s group by all)
select r.output, r.codec, r.height, coalesce((select max(mean) from s where s.output = r.output and s.codec = r.codec and s.label = concat(r.height, 'p')),
  (select arg_min(mean, label) from s where s.output = r.output and s.codec = r.codec and starts_with(s.label, concat(r.height, 'p_')))) as vmaf, model, common_height
from r join m using (output, codec)""")
def _(v):
    s = v.spark.sql(_SCORES.replace("from vmaf_parts", "from {t}"), t=v.vmaf_parts)
    r = s.select("output", "codec").distinct().withColumn("height", F.explode(F.array(*map(F.lit, (234, 360, 540, 2160)))))
    return retention.rung_scores(r, s)


@query("O31_worker_state", """
with c as (select s_suppkey as machine, s_acctbal < 0 as disabled from supplier), p as (select distinct machine from samples where machine % 3 <> 0), l as (select machine, max(ts) as t from samples where machine % 5 <> 0 group by machine),
m as (select machine from c union select machine from p union select machine from l)
select m.machine, case when coalesce(disabled, false) then 'disabled' when p.machine is not null and greatest(1706700000 - t, 0) <= 150 then 'polling' when t is not null then 'stale' else 'never' end as state,
       case when t is null then 0 else greatest(1706700000 - t, 0) end as age_s, c.machine is not null as configured
from m left join c using (machine) left join p using (machine) left join l using (machine)""")
def _(v):
    return fleet.worker_state(v.supplier.select(F.col("s_suppkey").alias("machine"), (F.col("s_acctbal") < 0).alias("disabled")), v.samples.where("machine % 3 <> 0"), v.samples.where("machine % 5 <> 0").withColumnRenamed("ts", "last_poll"), 1_706_700_000)


MEMBERS = "m as (select instance, true as registered, instance % 7 = 0 as draining, instance % 4 as running, instance % 3 as pending from fleet where instance % 5 <> 0)"


@query("O32_instance_state", f"""
with {MEMBERS}
select f.instance, case when state = 'terminated' then 'leaving' when registered is null and {T} - launch < 300 then 'booting' when coalesce(draining, false) then 'draining' when running > 0 then 'running' when pending > 0 then 'pulling' else 'idle' end as init_state,
       {T} - launch as age_s from fleet f left join m using (instance)""")
def _(v):
    i = F.col("instance")
    m = v.fleet.where("instance % 5 <> 0").select("instance", F.lit(True).alias("registered"), (i % 7 == 0).alias("draining"), (i % 4).alias("running"), (i % 3).alias("pending"))
    return fleet.instance_state(v.fleet, m, T)


@query("O33_terminated_at", """
select instance, ended as ended from fleet""")
def _(v):
    r = F.when(F.col("ended").isNotNull(), F.concat(F.lit("User initiated ("), F.date_format(F.timestamp_seconds("ended"), "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT)"))).otherwise("none")
    return fleet.terminated_at(v.fleet.select("instance", r.alias("reason"))).select("instance", "ended")


@query("O36_live_fleet_filter", "select seq, machine from samples where machine in (select instance from fleet where state <> 'terminated')")
def _(v):
    return fleet.live_fleet_filter(v.samples, v.fleet).select("seq", "machine")


@query("O37_keep_list_anti", "select doc_id as id from documents where doc_id not in (select doc_id from labels where doc_id is not null) and doc_id not in (select conv_id from conversations where conv_id is not null)")
def _(v):
    return retention.keep_list_anti(v.documents.select(F.col("doc_id").alias("id")), v.labels.select(F.col("doc_id").alias("id")), v.conversations.select(F.col("conv_id").alias("id")))


@query("O38_gone_under_prefix", """
with d as (select distinct concat('jobs/', page_id % 50) as p from pages where page_id % 50 < 6 union select concat('jobs/', doc_id % 50, '/p', doc_id) from documents where doc_id % 16 = 0)
select output, s3_prefix from outputs where exists (select 1 from d where s3_prefix = p or starts_with(s3_prefix, concat(p, '/')))""")
def _(v):
    d = v.pages.where("page_id % 50 < 6").select(F.concat(F.lit("jobs/"), F.col("page_id") % 50, F.lit("/")).alias("prefix"))
    d = d.unionByName(v.documents.where("doc_id % 16 = 0").select(F.concat(F.lit("jobs/"), F.col("doc_id") % 50, F.lit("/p"), F.col("doc_id")).alias("prefix")))
    return retention.gone_under_prefix(v.outputs, d).select("output", "s3_prefix")


@query("O39_enrich_fleet", """
with r as (select instance, job_id, start_s, vcpu, row_number() over (partition by instance order by start_s desc, job_id) as rn from batch_jobs where status = 'RUNNING' and instance % 9 <> 0),
u as (select instance, sum(vcpu) as u, count(*) as n, string_agg(job_id::varchar, ',' order by rn) as newest from r group by instance)
select f.instance, f.type, f.vcpu as box_vcpu, least(coalesce(u, 0), f.vcpu)::bigint as used_vcpu, (f.vcpu - least(coalesce(u, 0), f.vcpu))::bigint as idle_vcpu, coalesce(n, 0) as jobs, newest from fleet f left join u using (instance)""")
def _(v):
    j = v.batch_jobs
    j = j.withColumn("member", F.concat(F.lit("cluster/"), "instance")).drop("instance")
    members = v.fleet.where("instance % 9 <> 0").select(F.concat(F.lit("cluster/"), "instance").alias("member"), "instance")
    return fleet.enrich_fleet(j.unionByName(j.where("job_id % 10 = 0")), v.fleet, members)


@query("O68_inventory_summary", f"""
select count(*) filter (where state = 'running') as running, count(*) filter (where state = 'running' and launch < {T} - 6000) as orphans,
       round(sum(coalesce(spot_price, vcpu * 0.036)) filter (where state = 'running'), 4) as hourly_usd, (select sum(bytes)::bigint from objects) as bytes from fleet""")
def _(v):
    return fleet.inventory_summary(v.fleet, v.objects, T, 6000)


@query("O70_version_skew", """
with m as (select fleet, machine, arg_max(version, seq) filter (where version is not null) as version from samples group by all)
select fleet, count(distinct version) as versions, count(distinct version) > 1 as mixed, count(*) filter (where version is null) as unknown, coalesce(string_agg(distinct version, ',' order by version), '') as seen from m group by fleet""")
def _(v):
    return fleet.version_skew(v.samples)


@query("O82_spend_integral", f"""
with s as (select fleet, ts, seq, busy, lead(ts) over o - ts as dt, (lead(busy) over o + busy) / 2 as mid from samples where ts between {J} - 864000 and {J} window o as (partition by fleet order by ts, seq))
select fleet, round(coalesce(sum(mid * dt / 3600) filter (where dt > 0 and dt <= 3600), 0), 4) as spent, count(*) as samples from s group by fleet""")
def _(v):
    return fleet.spend_integral(v.samples.withColumnRenamed("busy", "rate"), J, 864_000)


@query("O83_downsample_history", f"""
with s as (select *, row_number() over (partition by fleet order by ts, seq) - 1 as i, count(*) over (partition by fleet) as n from samples where ts between {J} - 864000 and {J})
select fleet, seq, ts, round(100 * busy / perf, 4) as used_pct from s where i % (case when n > 180 then floor(n / 180) + 1 else 1 end) = 0""")
def _(v):
    return fleet.downsample_history(v.samples, J, 864_000)


_CHUNKS = "concat('c', k % 5, '|c', k % 3)"

VIEW = f"""
with recursive one as (select machine, ts, min(seq) as seq from samples group by all),
k as (select machine, min(ts) as ts from one group by machine union all select k.machine, min(o.ts) from k join one o on o.machine = k.machine and o.ts >= k.ts + 3600 group by k.machine),
g as (select s.*, round(100 * s.busy / s.perf, 4) as pct, row_number() over (partition by s.machine order by s.ts desc) as rn from samples s join one using (machine, seq) join k on k.machine = s.machine and k.ts = s.ts),
a as (select machine, max(ts) as ts, max(case when rn = 1 then pct end) as used_pct, round(avg(100 * busy / perf), 4) as mean_pct, count(*) as samples, string_agg(cast(floor(pct) as bigint), ',' order by rn desc) as history from g where rn <= 90 group by machine),
f as (select machine, arg_max(version, (ts, seq)) filter (where version is not null) as version, min(ts) as first_seen, arg_max({_CHUNKS}, (ts, seq)) as chunks from samples group by machine)
"""


@query("O113_fleet_view", VIEW + f"select machine, {J} - ts as age_s, used_pct, mean_pct, samples, history, chunks, version, first_seen from a join f using (machine) where ts >= {J} - 864000")
def _(v):
    view = fleet.fleet_view(v.samples.withColumn("chunks", F.expr(_CHUNKS)), J, 864_000, gap_s=3600)
    return view.withColumn("history", F.array_join(F.transform("history", lambda x: F.floor(x).cast("string")), ","))


@query("O106_fleet_order", """
with m as (select fleet, machine, case when machine % 9 = 0 then null else min(ts) end as first_seen from samples group by fleet, machine)
select *, row_number() over (partition by fleet order by first_seen nulls last, machine) as place from m""")
def _(v):
    m = v.samples.groupBy("fleet", "machine").agg(F.min("ts").alias("first_seen")).withColumn("first_seen", F.when(F.col("machine") % 9 != 0, F.col("first_seen")))
    return fleet.fleet_order(m)


@query("O106_usage_order", """
with u as (select split_part(key, '/', 1) as top, split_part(key, '/', 2) as prefix, sum(bytes)::bigint as bytes from objects group by all)
select *, row_number() over (partition by top order by bytes desc, prefix) as place from u""")
def _(v):
    u = v.objects.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("top"), F.split_part("key", F.lit("/"), F.lit(2)).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    return fleet.usage_order(u, ["top"])


@query("O106_phase_order", """
with p as (select job, regexp_replace(key, ':chunk[^:]*$', '') as phase, min(seq) as first_seq from stages group by all)
select *, row_number() over (partition by job order by first_seq, phase) as place from p""")
def _(v):
    return fleet.phase_order(v.stages.groupBy("job", S.phase_key("key").alias("phase")).agg(F.min("seq").alias("first_seq")))


@query("O118_host_counter_rate", """
with recursive c as (select machine, ts, seq, sum(busy) over o as idle, sum(busy + k) over o as total, row_number() over o as i from samples window o as (partition by machine order by ts, seq)),
k as (select machine, ts, seq, idle, total, cast(null as double) as busy from c where i = 1
  union all select b.machine, c.ts, c.seq, c.idle, c.total, case when c.total > b.total then greatest(0, 1 - (c.idle - b.idle) / (c.total - b.total)) * 8 end
  from k b, lateral (select * from c n where n.machine = b.machine and n.ts >= b.ts + 7200 order by n.i limit 1) c)
select machine, seq, round(busy, 4) as busy from k where busy is not null""")
def _(v):
    from pyspark.sql import Window as W

    by = W.partitionBy("machine").orderBy("ts", "seq")
    return fleet.host_counter_rate(v.samples.withColumn("idle", F.sum("busy").over(by)).withColumn("total", F.sum(F.col("busy") + F.col("k")).over(by)), 8, 7200)


@query("O104_recent_executions", """
with e as (select concat('arn:', run) as arn, started_at as started, case when run % 50 = 0 then 'RUNNING' else 'SUCCEEDED' end as status from run_samples)
select * from e order by status = 'RUNNING' desc, started desc, arn limit 25""")
def _(v):
    e = v.run_samples.select(F.concat(F.lit("arn:"), "run").alias("arn"), F.col("started_at").alias("started"), F.when(F.col("run") % 50 == 0, "RUNNING").otherwise("SUCCEEDED").alias("status"))
    return fleet.recent_executions(e.unionByName(e.where("started % 7 = 0")))


@query("O105_active_jobs_order", """
select exec, job_id, greatest(start_s, coalesce(stop_s, 0)) as latest,
       row_number() over (partition by exec order by case status when 'RUNNING' then 0 when 'STARTING' then 1 when 'RUNNABLE' then 2 when 'SUBMITTED' then 3 else 4 end, greatest(start_s, coalesce(stop_s, 0)) desc, job_id) as place from batch_jobs""")
def _(v):
    return fleet.active_jobs_order(v.batch_jobs).select("exec", "job_id", "latest", "place")


@query("O126_leak_view", """
select concat('i-', instance) as id, 'instance' as kind, round(coalesce(spot_price, case when type = 'c7g.medium' then null else vcpu * 0.0363 end, 0), 4) as hourly_usd from fleet where state <> 'terminated'
union all select concat('v-', p_partkey), 'volume', round(p_size * 0.08 / 730, 4) from part where p_partkey % 3 = 0""")
def _(v):
    prices = v.fleet.where("type <> 'c7g.medium'").groupBy("type").agg((F.max("vcpu") * 0.0363).alias("list_price"))
    vol = v.part.select(F.col("p_partkey").alias("volume"), F.when(F.col("p_partkey") % 3 != 0, F.lit("x")).alias("attached"), F.col("p_size").alias("gb"))
    return fleet.volumes_view(vol, v.fleet, prices)


@query("O134_stale_instances", f"""
select instance, type, state, {T} - launch as age_s, round(coalesce(spot_price, vcpu * 0.036), 4) as hourly_usd, concat(type, '/', instance) as label from fleet where state in ('running', 'pending') and {T} - launch >= 6000""")
def _(v):
    return fleet.stale_instances(v.fleet, T, 6000)


GC = "with u as (select array_to_string(string_split(key, '/')[1:2], '/') as prefix, count(*) as objects, sum(bytes)::bigint as bytes, 1700100000 - max(modified) as idle_s from objects where len(string_split(key, '/')) > 2 group by 1)"


@query("O61_prefix_usage", GC + "select * from u")
def _(v):
    return retention.prefix_usage(v.objects, 1_700_100_000)


def kept(v):
    return v.labels.where("doc_id % 4 = 0").select(F.concat(F.lit("jobs/"), F.col("doc_id") % 50).alias("prefix")).distinct()


KEEP = ", keep as (select distinct concat('jobs/', doc_id % 50) as prefix from labels where doc_id % 4 = 0)"


@query("O120_staging_gc", GC + KEEP + """
select prefix, objects, bytes, idle_s, case when prefix in (select prefix from keep) then 'skipped' when idle_s >= case when starts_with(prefix, 'mezz/') then 7200 else 20000 end then 'would-delete' else 'skipped' end as action from u""")
def _(v):
    return retention.staging_gc(v.objects, kept(v), 1_700_100_000, 20_000, 7_200)


@query("O69_action_summary", GC + KEEP + """
, a as (select split_part(prefix, '/', 1) as scope, case when prefix in (select prefix from keep) then 'skipped' when idle_s >= 7200 then 'would-delete' else 'skipped' end as action from u)
select scope, count(*) filter (where action = 'would-delete') as would_delete, 0::bigint as deleted, count(*) filter (where action = 'skipped') as skipped, 0::bigint as held from a group by scope""")
def _(v):
    g = retention.staging_gc(v.objects, kept(v), 1_700_100_000, 7_200, 7_200)
    return fleet.action_summary(g.withColumn("scope", F.split_part("prefix", F.lit("/"), F.lit(1))))


@query("O121_tmp_gc", """
with f as (select case when doc_id % 6 = 0 then concat('x', doc_id % 90) else (doc_id % 90)::varchar end as job, 1700000000 + doc_id * 110 as mtime, n_chars as bytes from documents),
g as (select job, max(mtime) as newest, sum(bytes)::bigint as bytes from f where regexp_full_match(job, '[0-9]+') group by job)
select * from g where newest < 1700200000 - 90000 and job not in (select (doc_id % 90)::varchar from labels where doc_id % 9 = 0)""")
def _(v):
    d = F.col("doc_id")
    f = v.documents.select(F.when(d % 6 == 0, F.concat(F.lit("x"), d % 90)).otherwise((d % 90).cast("string")).alias("job"), (1_700_000_000 + d * 110).alias("mtime"), F.col("n_chars").alias("bytes"))
    return retention.tmp_gc(f, v.labels.where("doc_id % 9 = 0").select((d % 90).cast("string").alias("job")), 1_700_200_000, 90_000)


ARCHIVE = r"""
with b as (select output, name, regexp_replace(name, '_\d{8}(_\d{6})?$', '') as base, bytes, sidecar, output % 13 = 0 as keep from outputs where regexp_matches(name, '_\d{8}(_\d{6})?$') and mtime < {now} - 2592000),
live as (select distinct name as base from outputs where not regexp_matches(name, '_\d{8}(_\d{6})?$')),
h as (select output, name, base, bytes, case when sidecar then 'sidecar' when keep then 'keep' when base in ('clip3_en', 'clip6_en', 'clip9_fr') then 'active' when base not in (select base from live) then 'orphan' end as held from b)
"""


def archive(v):
    o = v.outputs.withColumn("keep", F.col("output") % 13 == 0)
    active = v.nation.select(F.when(F.col("n_nationkey") % 3 == 0, "clip3_en").when(F.col("n_nationkey") % 3 == 1, "clip6_en").otherwise("clip9_fr").alias("stem"))
    return retention.archive_gc(o, active, NOW, 2_592_000)


@query("O122_archive_gc", ARCHIVE + "select * from h")
def _(v):
    return archive(v)


@query("O122_held_bytes", ARCHIVE + "select coalesce(held, 'reclaimable') as reason, count(*) as n, sum(bytes)::bigint as bytes from h group by 1")
def _(v):
    return retention.held_bytes(archive(v))


@query("O123_failed_staging_gc", """
with p as (select *, array_to_string(string_split(key, '/')[1:2], '/') as prefix from objects)
select prefix, count(*) as objects, sum(bytes)::bigint as bytes from p where prefix in (select prefix from p where key like '%/\\_FAILED' escape '\\' and modified < 1700100000 - 50000) group by prefix""")
def _(v):
    return retention.failed_staging_gc(v.objects, 1_700_100_000, 50_000)


@query("O124_stale_uploads", """
with p as (select key, modified as initiated, array_to_string(string_split(key, '/')[1:2], '/') as prefix from objects where starts_with(key, 'jobs/') and modified < 1700100000 - 60000)
select key, initiated, prefix from p where prefix not in (select concat('jobs/', doc_id % 50) from labels where doc_id % 4 = 0)""")
def _(v):
    return retention.stale_uploads(v.objects.select("key", F.col("modified").alias("initiated")), kept(v), 1_700_100_000, 60_000)


@query("O125_purge_speed_keys", """
with k as (select concat_ws(':', case when pos % 2 = 0 then 'mac' else 'cloud' end, codec, height, pos % 2 + 1, 'medium', case when pos % 7 = 0 then null else '30' end) as key, pos from rungs)
select key, pos, codec_hit and n = 6 as doomed from (select *, len(string_split(key, ':')) as n, string_split(key, ':')[2] = 'hevc' and string_split(key, ':')[4] = '2' as codec_hit from k)""")
def _(v):
    p = F.col("pos")
    key = F.concat_ws(":", F.when(p % 2 == 0, "mac").otherwise("cloud"), "codec", F.col("height").cast("string"), (p % 2 + 1).cast("string"), F.lit("medium"), F.when(p % 7 != 0, "30"))
    return retention.purge_speed_keys(v.rungs.select(key.alias("key"), "pos"), "hevc", "2")


@query("O35_stable_new_files", """
with s as (select concat('clip', seq % 300, case seq % 6 when 0 then '.mp4' when 1 then '.m4v' when 2 then '.m3u8' when 3 then '.MKV' when 4 then '.mxf' else '.MOV' end) as name, seq as scan, (k // 50) as size from samples),
l as (select *, lag(size) over o as b, lead(scan) over o is null as last from s window o as (partition by name order by scan))
select name, regexp_replace(name, '\\.[^.]*$', '') as stem, size from l where last and size > 0 and size = b and lower(name) similar to '.*\\.(mp4|mov|mkv|m3u8)'
  and not exists (select 1 from outputs o where o.name = regexp_replace(l.name, '\\.[^.]*$', '') or starts_with(o.name, concat(regexp_replace(l.name, '\\.[^.]*$', ''), '_')))""")
def _(v):
    q = F.col("seq")
    s = v.samples.select(F.concat(F.lit("clip"), q % 300, F.when(q % 6 == 0, ".mp4").when(q % 6 == 1, ".m4v").when(q % 6 == 2, ".m3u8").when(q % 6 == 3, ".MKV").when(q % 6 == 4, ".mxf").otherwise(".MOV")).alias("name"), q.alias("scan"), F.expr("k div 50").alias("size"))
    return retention.stable_new_files(s, v.outputs)


@query("O46_census_repair", """
with s as (select job_id as key, case job_id % 5 when 0 then 'pending' when 1 then 'queued' when 2 then 'running' when 3 then 'done' else 'failed' end as status from batch_jobs where job_id % 7 > 0),
b as (select job_id as key, case status when 'RUNNABLE' then 'queued' when 'RUNNING' then 'running' when 'SUCCEEDED' then 'done' else 'failed' end as snap from batch_jobs where job_id % 7 = 0 or job_id % 3 > 0),
r(n, r) as (values ('pending', 0), ('queued', 1), ('running', 3), ('failed', 4), ('done', 5))
select key, status, snap, case when snap is null then 'absent' when status is null then 'seeded' when status in ('done', 'failed') then 'protected' when rs.r > rt.r then 'repaired' else 'unchanged' end as action
from s full join b using (key) left join r rs on rs.n = snap left join r rt on rt.n = status""")
def _(v):
    i = F.col("job_id")
    s = v.batch_jobs.where("job_id % 7 > 0").select(i.alias("key"), F.when(i % 5 == 0, "pending").when(i % 5 == 1, "queued").when(i % 5 == 2, "running").when(i % 5 == 3, "done").otherwise("failed").alias("status"))
    return retention.census_repair(s, v.batch_jobs.where("job_id % 7 = 0 or job_id % 3 > 0").select(i.alias("key"), F.col("status").alias("batch")))


@query("O47_diff_sync", """
select key as rel, bytes as size, not (modified % 4 = 0 or modified % 4 = 1 and bytes % 2 = 0) as fetch from objects""")
def _(v):
    o = v.objects.select(F.col("key").alias("rel"), F.col("bytes").alias("size"), "modified")
    local = o.where("modified % 4 = 0").select("rel", "size").unionByName(o.where("modified % 4 = 1").select("rel", (F.col("size") - F.col("size") % 2).alias("size")))
    return retention.diff_sync(o, local)


@query("O48_splice_snapshot", """
with i as (select distinct fleet as bucket, ts as t, case when seq % 3 = 0 then seq end as bytes, true as wanted from samples),
u as (select bucket, t, bytes, wanted, null as e from i union all select fleet, ts + seq % 7 * 600, null, false, {'a': ts + seq % 7 * 600, 'b': seq} from samples),
w as (select *, max(e) over (partition by bucket order by t range between unbounded preceding and current row) as newest from u)
select bucket, t as fetched_at, coalesce(bytes, newest.b) as bytes, case when bytes is null then newest.a end as as_of from w where wanted""")
def _(v):
    s = v.samples
    i = s.select(F.col("fleet").alias("bucket"), F.col("ts").alias("fetched_at"), F.when(F.col("seq") % 3 == 0, F.col("seq")).alias("bytes"))
    return retention.splice_snapshot(i, s.select(F.col("fleet").alias("bucket"), (F.col("ts") + F.col("seq") % 7 * 600).alias("at"), F.col("seq").alias("listed_bytes")))


@query("O49_output_logs", r"""
with n as (select distinct lower(n_name) as name from nation union select 'the' union select 'les' union select 'de la'), j as (select s_suppkey * 1000 as log, lower(substr(n_name, 1, 4)) as stem from supplier join nation on s_nationkey = n_nationkey),
a as (select distinct log, name from j join n on starts_with(name, stem)),
c as (select distinct conv_id * 1000 + turn as log, name from conversations join n on contains(lower(substr(text, 1, 4096)), name))
select log, name, 'job' as how from a union all select log, name, 'content' from c anti join a using (log, name)""")
def _(v):
    own = F.when(F.col("n_nationkey") == 0, "the").when(F.col("n_nationkey") == 1, "de la").otherwise("les")
    names = v.nation.select(F.lower("n_name").alias("name")).unionByName(v.nation.select(own.alias("name")))
    jobs = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") * 1000).alias("log"), F.lower(F.substring("n_name", 1, 4)).alias("stem"))
    return retention.output_logs(v.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("log"), F.lower("text").alias("content")), names, jobs)


@query("O42_source_for_dir", """
with f as (select s_suppkey as job, case when s_suppkey % 3 = 0 then ['in/clip.mp4'] else ['in/clip1.mp4', 'in/clip2.mp4', 'clip1_b.mov'] end as files from supplier),
d as (select s_suppkey as job, unnest([concat('clip1_b_', s_nationkey), concat('clip2_', s_nationkey), 'other']) as dir from supplier)
select d.job, d.dir, case when len(files) = 1 then files[1] when starts_with(dir, 'clip1') then files[1] when starts_with(dir, 'clip2') then files[2] end as source from d join f using (job)""")
def _(v):
    s = v.supplier
    f = s.select(F.col("s_suppkey").alias("job"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("in/clip.mp4"))).otherwise(F.array(*[F.lit(x) for x in ("in/clip1.mp4", "in/clip2.mp4", "clip1_b.mov")])).alias("files"))
    d = s.select(F.col("s_suppkey").alias("job"), F.explode(F.array(F.concat(F.lit("clip1_b_"), "s_nationkey"), F.concat(F.lit("clip2_"), "s_nationkey"), F.lit("other"))).alias("dir"))
    return retention.source_for_dir(f, d)
