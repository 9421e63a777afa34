"""Queries over documents, listings and manifests.

The texts of playlists, manifests, logs and records are made by Spark from the tables, so the readers' work grows
with them; readers that take a path are run over files that Spark writes from the tables to the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from encodelens.functions import scalars as S
from encodelens.operators import manifests
from encodelens.plans.registry import query
from encodelens.sources import files
from encodelens.streaming import store


def folder(v, name: str) -> str:
    """A new folder in the shared space of the cluster; a temporary one only where none is set, as in tests."""
    base = v.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not v.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("O05_read_run_records", """
select concat('r', o_orderkey) as job_id, case when o_orderkey % 2 = 0 then 'hevc' end as codec, round(o_totalprice, 2) as total, o_custkey as phase_n from orders where o_orderkey % 9 <> 0""")
def _(v):
    o = v.orders
    r = F.struct(F.concat(F.lit("r"), "o_orderkey").alias("job_id"), F.struct(F.when(F.col("o_orderkey") % 2 == 0, "hevc").alias("codec")).alias("config"), F.struct(F.round("o_totalprice", 2).alias("total")).alias("cost"), F.array(F.struct(F.lit("encode").alias("phase"), F.col("o_custkey").alias("n"))).alias("phases"), F.lit(1).alias("future_field"))
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit('{"job_id": broken')).otherwise(F.to_json(r))
    path = folder(v, "run-records")
    o.select(text.alias("value")).write.text(path)
    spark = v.spark
    df = spark.read.schema(files.RUN_RECORD).json(path)
    return files.usable(df).select("job_id", "config.codec", "cost.total", F.col("phases")[0]["n"].alias("phase_n"))


@query("O06_read_sidecars", """
select s3_prefix, expires_at, gone from outputs where output % 30 <> 0""")
def _(v):
    o = v.outputs
    path = folder(v, "sidecars")
    o.select(F.when(F.col("output") % 30 == 0, "").otherwise(F.col("s3_prefix")).alias("s3_prefix"), "expires_at", "gone").write.json(path)
    return files.sidecars(v.spark.read.schema(files.SIDECAR).json(path)).select("s3_prefix", "expires_at", "gone")


@query("O08_scan_outputs", r"""
select name, sum(bytes)::bigint as bytes, count(*) as files, max(mtime) as mtime from outputs where not regexp_matches(name, '_\d{8}(_\d{6})?$') group by name""")
def _(v):
    listing = v.outputs.select(F.concat("name", F.lit("/f"), "output").alias("rel"), "bytes", "mtime")
    top = v.outputs.select(F.concat(F.lit("loose"), "output").alias("rel"), "bytes", "mtime")
    return files.scan_outputs(listing.unionByName(top))


@query("O09_scan_output_files", """
select output, file, sum(bytes)::bigint as bytes from (select split_part(key, '/', 1) as output, substr(key, instr(key, '/') + 1) as file, bytes from objects) group by rollup (output, file)""")
def _(v):
    return files.output_files(v.objects.select(F.col("key").alias("rel"), "bytes"))


@query("O10_parse_playlist", """
select concat(ladder, codec, pos) as path, 1 as line_no, 'variant' as kind, cast(null as double) as duration, kbps * 1000::bigint as bandwidth, case when pos % 2 = 0 then kbps * 900::bigint end as average_bandwidth, width, height, concat('v', pos, '.m3u8') as uri from rungs
union all select concat(ladder, codec, pos), 3, 'segment', (pos % 60) / 10.0, null, null, null, null, concat('s', pos, '.m4s') from rungs""")
def _(v):
    r = v.rungs
    head = F.concat(F.lit("#EXT-X-STREAM-INF:"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("AVERAGE-BANDWIDTH="), F.col("kbps") * 900, F.lit(","))).otherwise(F.lit("")), F.lit("BANDWIDTH="), F.col("kbps") * 1000, F.lit(",RESOLUTION="), "width", F.lit("x"), "height")
    seg = F.concat(F.lit("#EXTINF:"), F.format_string("%.1f", (F.col("pos") % 60) / 10), F.lit(","))
    lines = F.array(F.lit("#EXTM3U"), head, F.concat(F.lit("v"), "pos", F.lit(".m3u8")), seg, F.concat(F.lit("s"), "pos", F.lit(".m4s")))
    return manifests.parse_playlist(r.select(F.concat("ladder", "codec", "pos").alias("path"), F.posexplode(lines).alias("line_no", "line")))


@query("O11_parse_mpd", """
select concat('m', pos) as path, id, bandwidth, 640 as width, 360 as height, '30000/1001' as frame_rate, 'avc1' as codecs, 1000::bigint as timescale, n, total, 2::bigint as urls
from (select pos, unnest([concat('v', pos), concat('w', pos)]) as id, unnest([kbps * 1000, kbps * 1000 + 1])::bigint as bandwidth, (pos % 4 + 2)::bigint as n, ((pos % 4 + 1) * 4000 + 1500)::bigint as total from rungs)""")
def _(v):
    rep = lambda name, bw: F.format_string('<Representation id="%s" bandwidth="%d" codecs="avc1"><SegmentList timescale="1000"><SegmentTimeline><S d="4000" r="%d"/><S d="1500"/></SegmentTimeline><SegmentURL media="a.m4s"/><SegmentURL media="b.m4s"/></SegmentList></Representation>', F.concat(F.lit(name), "pos"), bw, F.col("pos") % 4)
    xml = F.concat(F.lit('junk\n<?xml version="1.0"?><MPD><Period><AdaptationSet contentType="video" width="640" height="360" frameRate="30000/1001">'), rep("v", F.col("kbps") * 1000), rep("w", F.col("kbps") * 1000 + 1), F.lit("</AdaptationSet></Period></MPD>"))
    m = manifests.parse_mpd(v.rungs.select(F.concat(F.lit("m"), "pos").alias("path"), xml.alias("value")))
    return m.select("path", "id", "bandwidth", "width", "height", "frame_rate", "codecs", "timescale", F.size("durations").cast("long").alias("n"), F.aggregate("durations", F.lit(0).cast("long"), lambda a, d: a + d).alias("total"), F.size("urls").cast("long").alias("urls"))


@query("O12_strip_leading_junk", """
select page_id, case when page_id % 3 = 0 then length(html) + 4 else length(html) + 21 end::bigint as n from pages""")
def _(v):
    k = F.col("page_id") % 3
    body = F.when(k == 0, F.concat(F.lit("none"), "html")).when(k == 1, F.concat(F.lit("xyz"), F.lit('<?xml version="1.0"?>'), "html")).otherwise(F.concat(F.lit('<?xml version="1.0"?>'), "html"))
    return manifests.strip_leading_junk(v.pages.select("page_id", body.alias("value"))).select("page_id", F.length("value").cast("long").alias("n"))


@query("O13_parse_ffmpeg_log", """
select publisher as source, concat('-i "a ', seq, '.mp4" -vf ''scale=1:2, pad'' x\\ y') as command, concat('-i|a ', seq, '.mp4|-vf|scale=1:2, pad|x y') as argv from markers where seq % 3 = 1""")
def _(v):
    """Lines of commands with quotes, of which those of an unclosed one go, among other lines."""
    command = F.concat(F.lit('12:00 [ffmpeg] -i "a '), "seq", F.lit(".mp4\" -vf 'scale=1:2, pad' x\\ y"))
    line = F.when(F.col("seq") % 3 == 0, F.col("raw")).when(F.col("seq") % 3 == 1, command).otherwise(F.concat(F.lit("[ffmpeg] -i 'x"), "seq"))
    out = files.parse_ffmpeg_log(v.markers.select(F.col("publisher").alias("source"), line.alias("line")))
    return out.withColumn("argv", F.array_join("argv", "|"))


@query("O14_read_rate_quality_csv", "select codec, clip as mode, height::varchar as resolution, kbps / 1000 as bitrate_mbps, vmaf from curves where kbps % 1700 <> 0")
def _(v):
    path = folder(v, "sweep")
    c = v.curves
    rate = F.when(F.col("kbps") % 1700 == 0, "n/a").otherwise((F.col("kbps") / 1000).cast("string"))
    c.select("codec", F.col("clip").alias("mode"), F.col("height").cast("string").alias("resolution"), rate.alias("bitrate_mbps"), "vmaf").write.option("header", True).csv(path)
    return files.read_sweep_csv(v.spark, path)


@query("O21_stream_sink", "select key, arg_max(status, seq) as status, max(seq) as seq from transitions group by key")
def _(v):
    """A stream of four files into a keyed table, and what a reader has that took the list once and changes from then on."""
    path, t = folder(v, "job-state"), v.transitions.select("key", "status", "seq")
    for n in range(4):
        t.where(F.col("seq") % 4 == n).write.mode("append").parquet(f"{path}/in/part={n}")
    table = store.KeyedStore(v.spark, f"{path}/table", ["key"], "seq", buckets=16)
    table.put(t.where("seq % 4 = 0"), 0, "first")
    kind, had, at = table.follow("page")
    table.acknowledge("page", at)
    stream = v.spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in/*")
    q = stream.writeStream.foreachBatch(table.put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    kind, changes, _ = table.follow("page")
    both = had.withColumn("_version", F.lit(at)).unionByName(changes)
    return both.groupBy("key").agg(F.max_by(F.struct("status", "seq"), "_version").alias("r")).select("key", "r.*")


@query("O34_observed_format", """
with f as (select output % 200 as output, max(case when output % 3 = 1 then 1 else 0 end) as m, max(case when output % 3 = 2 then 1 else 0 end) as t, max(case when output % 5 = 0 then 1 else 0 end) as p from outputs group by 1)
select output, case when m + t = 2 then 'both' when m = 1 then 'fmp4' when t = 1 then 'ts' when p = 1 then 'ts' end as format from f""")
def _(v):
    i = F.col("output")
    f = v.outputs.select((i % 200).alias("output"), F.concat(F.lit("s"), F.when(i % 3 == 1, ".m4s").when(i % 3 == 2, ".ts").otherwise(".mp4")).alias("name"), F.lit(None).cast("boolean").alias("says_map"), (i % 5 == 0).alias("says_ts"))
    return manifests.observed_format(f)


@query("O71_settings_diff", """
with c as (select concat(codec, height) as rung, concat('-i <PATH> -c:v ', codec, ' -b:v ', kbps // 500, ' -y') as settings, case pos % 3 when 0 then 'cloud' when 1 then 'local' else 'dist' end as source from rungs),
s as (select rung, settings, string_agg(distinct source, ',' order by source) as sources, count(*) as n from c group by all)
select *, count(*) over (partition by rung) > 1 as divergent from s""")
def _(v):
    argv = F.array(F.lit("-i"), F.concat(F.lit("/in/"), "pos"), F.lit("-c:v"), F.col("codec"), F.lit("-b:v"), F.expr("kbps div 500").cast("string"), F.lit("-y"))
    source = F.when(F.col("pos") % 3 == 0, "cloud").when(F.col("pos") % 3 == 1, "local").otherwise("dist")
    return manifests.settings_diff(v.rungs.select(F.concat("codec", "height").alias("rung"), S.normalize_argv(argv).alias("settings"), source.alias("source")))


_PATH = "case pos % 3 when 0 then 'cloud' when 1 then 'local' else 'dist' end"


@query("O71_chunk_plans", f"""
with c as (select distinct concat(codec, '_', height) as rung, case when pos % 3 = 0 then 'cloud' else 'local' end as path, concat(case when codec = 'h264' then kbps % 2 else kbps % 5 end * 6, '/', height) as span from rungs where pos % 11 > 0),
s as (select rung, span, bool_or(path = 'local') as l, bool_or(path = 'cloud') as c from c group by all)
select rung, count(*) filter (where l) as local, count(*) filter (where c) as cloud, count(*) filter (where l and c) as shared,
       case when not bool_or(l) or not bool_or(c) then 'one path only' when bool_and(l and c) then 'identical' else 'DIFFER' end as verdict from s group by rung""")
def _(v):
    """Command lines as three paths log them; a whole encode seeks nowhere and has no part in a plan."""
    seek = F.when(F.col("codec") == "h264", F.col("kbps") % 2).otherwise(F.col("kbps") % 5) * 6
    spans = F.when(F.col("pos") % 11 > 0, F.concat(F.lit("-ss "), seek.cast("string"), F.lit(" -frames:v "), "height", F.lit(" "))).otherwise(F.lit(""))
    line = F.concat(F.lit("ffmpeg -i '/in/a b.mp4' "), spans, F.lit('-vf "scale=1, 2" "/out/'), "codec", F.lit("_"), "height", F.lit("_c"), "pos", F.lit('.mp4"'))
    return manifests.chunk_plans(v.rungs.select(F.expr(_PATH).alias("path"), S.split_command(line).alias("argv")))


DELIVERED = """
with f as (select ladder as output, concat(codec, height) as rung, pos // 2 as file, max(kbps)::bigint * 700 as bytes, sum(3.7 + pos % 3)::double as duration, max(case when pos % 50 < 2 then 1 else 0 end) as remote from rungs group by all),
a as (select output, rung, sum(duration) as s, sum(bytes)::bigint as b, max(remote) = 1 as r from f group by all),
vr as (select ladder as output, concat(codec, height) as rung, max(kbps)::bigint * 1100 as peak, min(kbps)::bigint * 1000 as average from rungs group by all),
au as (select ladder as output, max(128000 + pos % 3 * 64000) as bits from rungs group by ladder having min(pos) % 2 = 0),
dc as (select output, rung, (greatest(peak - coalesce(bits, 0), 0) // 1000)::bigint as peak_kbps, (greatest(average - coalesce(bits, 0), 0) // 1000)::bigint as average_kbps from vr left join au using (output)),
dl as (select output, rung, round(s, 4) as seconds, case when not r then b end as bytes, round(case when not r then b * 8 / s / 1000 end, 4) as kbps from a)
"""


def delivered(v):
    p = F.col("pos")
    f = v.rungs.select(F.col("ladder").alias("output"), F.concat("codec", "height").alias("rung"), F.expr("pos div 2").alias("file"), (F.col("kbps").cast("long") * 700).alias("bytes"), (3.7 + p % 3).alias("duration"), (p % 50 < 2).alias("remote"))
    return manifests.delivered_kbps(f)


def declared(v):
    r = v.rungs.withColumnsRenamed({"ladder": "output"}).withColumn("rung", F.concat("codec", "height"))
    variants = r.groupBy("output", "rung").agg((F.max("kbps").cast("long") * 1100).alias("bandwidth"), (F.min("kbps").cast("long") * 1000).alias("average_bandwidth"))
    audio = r.groupBy("output").agg(F.max(128000 + F.col("pos") % 3 * 64000).alias("bits"), F.min("pos").alias("m")).where("m % 2 = 0")
    return manifests.declared_rates(variants, audio)


@query("O77_delivered_kbps", DELIVERED + "select * from dl join dc using (output, rung)")
def _(v):
    return delivered(v).join(declared(v), ["output", "rung"])


@query("O130_output_ladder", DELIVERED + """
, b as (select *, case when starts_with(rung, 'av1') then substr(rung, 4) else substr(rung, 5) end::int as height from dl),
own as (select ladder as output, concat(codec, height) as rung, max(kbps) as own, max(case when pos % 6 = 0 then 'high' else 'main' end) as profile from rungs where pos % 2 = 0 group by all),
st(height, tier) as (values (360, 800), (540, 1600), (720, 3000), (1080, 6000))
select output, rung, height, coalesce(own, tier) as target_kbps, kbps as actual_kbps, round(kbps / coalesce(own, tier), 4) as share, peak_kbps, average_kbps, bytes as size, case when own is not null then own / 100 end as vmaf, profile
from b left join own using (output, rung) left join dc using (output, rung) left join st using (height)""")
def _(v):
    a = delivered(v).withColumn("height", F.regexp_extract("rung", r"^(?:h264|hevc|av1)(\d+)$", 1).cast("int"))
    profile = F.max(F.when(F.col("pos") % 6 == 0, "high").otherwise("main")).alias("profile")
    own = v.rungs.where("pos % 2 = 0").groupBy(F.col("ladder").alias("output"), F.concat("codec", "height").alias("rung")).agg(F.max("kbps").alias("kbps"), profile).withColumn("vmaf", F.col("kbps") / 100)
    standard = v.spark.createDataFrame([(360, 800), (540, 1600), (720, 3000), (1080, 6000)], "height int, kbps int")
    return manifests.output_ladder(a, own, standard, declared(v))


FRAG = """
with s as (select p_partkey % 100 as track, p_partkey as segment, 4000 + p_size * 7 as duration, p_size % 4 + 1 as n from part),
fr as (select *, unnest(range(0, n)) as i from s), d as (select *, (duration // n + case when i = 0 then duration % n else 0 end)::bigint as d from fr)
"""


def fragmented(v):
    p = v.part.select((F.col("p_partkey") % 100).alias("track"), F.col("p_partkey").alias("segment"), (4000 + F.col("p_size") * 7).cast("long").alias("duration"), (F.col("p_size") % 4 + 1).alias("k"))
    f = p.select("track", "segment", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).select("track", "segment", (F.col("j") * 1000).cast("long").alias("offset"), F.lit(1000).alias("length"))
    return manifests.fragment_timeline(p.select("track", "segment", "duration"), f)


@query("O127_fragment_timeline", FRAG + """
select track, segment, i::int as i, (sum(d) over (partition by track order by segment, i) - d)::bigint as t, d, concat(i * 1000, '-', i * 1000 + 999) as range from d""")
def _(v):
    return fragmented(v).withColumn("i", F.col("i").cast("int"))


@query("O127_timeline_runs", FRAG + """
, t as (select track, d, sum(d) over (partition by track order by segment, i) - d as t from d), n as (select *, case when lag(d) over (partition by track order by t) = d then 0 else 1 end as new from t),
r as (select *, sum(new) over (partition by track order by t) as run from n)
select track, min(t)::bigint as t, min(d)::bigint as d, count(*) - 1 as r from r group by track, run""")
def _(v):
    return manifests.timeline_runs(fragmented(v).select("track", "t", "d"))


@query("O128_segment_regroup", """
with u as (select p_partkey % 50 as track, concat('seg', p_partkey % 400) as media, p_size % 3 * 2 as d, p_partkey as pos from part), g as (select track, media, sum(d) as d, min(pos) as pos from u group by all)
select track, media, case when d = 0 then 4.0 else d::double end as duration, row_number() over (partition by track order by pos) as place from g""")
def _(v):
    return manifests.segment_regroup(v.part.select((F.col("p_partkey") % 50).alias("track"), F.concat(F.lit("seg"), F.col("p_partkey") % 400).alias("media"), (F.col("p_size") % 3 * 2).alias("d"), F.col("p_partkey").alias("pos")))


@query("O129_variant_index", """
with a as (select ladder as output, 128000.5 as p, 96000.25 as v, 'mp4a.40.2' as c from rungs group by ladder having min(pos) % 2 = 0),
r as (select ladder as output, pos as rung, kbps * 1100.0 as p, kbps * 1000.0 as v, codec, width, height, pos % 7 + 0.2 as longest from rungs),
j as (select r.*, ceil(r.p + coalesce(a.p, 0))::bigint as bandwidth, ceil(r.v + coalesce(a.v, 0))::bigint as average_bandwidth, concat_ws(',', codec, a.c) as codecs from r left join a using (output))
select output, rung, bandwidth, average_bandwidth, codecs, ceil(longest)::bigint as target_duration,
       concat('#EXT-X-STREAM-INF:BANDWIDTH=', bandwidth, ',AVERAGE-BANDWIDTH=', average_bandwidth, ',CODECS="', codecs, '",RESOLUTION=', width, 'x', height) as line from j""")
def _(v):
    r = v.rungs
    a = r.groupBy(F.col("ladder").alias("output")).agg(F.min("pos").alias("m")).where("m % 2 = 0").select("output", F.lit(128000.5).alias("peak"), F.lit(96000.25).alias("average"), F.lit("mp4a.40.2").alias("codecs"))
    n = r.select(F.col("ladder").alias("output"), F.col("pos").alias("rung"), (F.col("kbps") * 1100.0).alias("peak"), (F.col("kbps") * 1000.0).alias("average"), F.col("codec").alias("codecs"), "width", "height", (F.col("pos") % 7 + 0.2).alias("longest"))
    return manifests.variant_index(n, a)
