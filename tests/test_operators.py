"""Exact small cases and loops that the operators must equal."""

import math
import random

import pytest
from pyspark.sql import functions as F

from encodelens.functions import scalars as S
from encodelens.operators import cost, curves, fleet, ladders, manifests, retention, series, stages
from encodelens.sources import files, markers
from encodelens.streaming import state

STAGE = "job string, key string, submitted long, started long, ended long, status string"


def active(spark, intervals, submitted=0, now=1000):
    rows = [("j", f"k{i}", submitted, s, e, "done") for i, (s, e) in enumerate(intervals)] or [("j", "k", submitted, None, None, "pending")]
    r = stages.active_time(spark.createDataFrame(rows, STAGE), now).first()
    return r.queued_s, r.active_s, r.span_s, r.idle_s


@pytest.mark.parametrize(
    "intervals, want",
    [
        ([(0, 100)] * 4, (0, 100, 100, 0)), ([(0, 10), (20, 30)], (0, 20, 30, 10)), ([(0, 10), (10, 20)], (0, 20, 20, 0)), ([(0, 100), (20, 30)], (0, 100, 100, 0)),
        ([(20, 30), (0, 10), (5, 25)], (0, 30, 30, 0)), ([(990, None)], (990, 10, 10, 0)), ([(50, 40)], (50, 0, 0, 0)), ([(None, 40), (10, 20)], (10, 10, 10, 0)), ([], (1000, 0, 0, 0)),
    ],
)
def test_active_time(spark, intervals, want):
    assert active(spark, intervals) == want


def loop_fold(events):
    old, pct, out = None, 0.0, []
    for seq, new, p, src in sorted(events):
        back = old is not None and old != "failed" and new not in ("failed", "reclaimed") and stages.RANK[new] < stages.RANK[old]
        ok = not (old == "done" and new != "done" or back)
        if ok:
            p = pct if p is None else p
            if old == new != "done" and p < pct:
                p = pct
            old, pct = new, p
        out.append((seq, ok, old, pct))
    return out


def random_events(seed, keys=6, n=300):
    rng = random.Random(seed)
    return [(i, f"k{rng.randrange(keys)}", rng.choice(list(stages.RANK)), rng.choice([None, 0.0, 10.0, 40.0, 90.0]), rng.choice("ab")) for i in range(n)]


EVENTS = "seq long, key string, status string, percent double, src string"


def test_stage_fold_is_the_loop(spark):
    ev = random_events(1)
    got = {}
    for r in stages.stage_state_fold(spark.createDataFrame(ev, EVENTS)).collect():
        got.setdefault(r.key, []).append((r.seq, r.accepted, r.status, r.percent))
    for k in got:
        assert sorted(got[k]) == loop_fold([(s, st, p, src) for s, key, st, p, src in ev if key == k])


def throttled(rows, gap):
    last, kept = {}, []
    for m, ts, seq in sorted(rows):
        if m not in last or ts - last[m] >= gap:
            last[m] = ts
            kept.append(seq)
    return sorted(kept)


def test_throttle(spark):
    rng = random.Random(4)
    rows = sorted((rng.randrange(3), rng.randrange(100), i) for i in range(120))
    df = spark.createDataFrame(rows, "machine long, ts long, seq long")
    assert sorted(r.seq for r in fleet.fleet_throttle(df, 3).collect()) == throttled(rows, 3)


def test_bands_are_the_loop(spark):
    rng = random.Random(5)
    rows = [(f"l{i % 4}", "h264", i, (w := rng.choice([416, 640, 960, 1280, 1920, 3840])), w * 9 // 16, 100) for i in range(60)]
    got = {}
    for r in ladders.decode_bands(spark.createDataFrame(rows, "ladder string, codec string, pos long, width int, height int, kbps int"), 3.0).collect():
        got.setdefault((r.ladder, r.band), []).append((r["at"], r.pos))
    want = {}
    for lad in {r[0] for r in rows}:
        band, used, cur = 0, 0.0, []
        for mp, pos in sorted((r[3] * r[4] / 1e6, r[2]) for r in rows if r[0] == lad and r[4] <= 1080):
            if used and used + mp > 3.0:
                band, used = band + 1, 0.0
            used += mp
            cur.append((band, -mp, pos))
        for b in {c[0] for c in cur}:
            members = [p for bb, m, p in sorted(cur) if bb == b]
            if len(members) > 1:
                want[lad, b] = members
    assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == want


@pytest.mark.parametrize("duration, chunk, segment", [(334.4, 30, 6), (334, 1, 1), (334, 30, 5), (100, 30, 10), (5, 30, 6), (61.5, 12, 6), (600, 60, 4), (30.5, 30, 6), (7200, 240, 6)])
def test_chunk_plan_tiles(spark, duration, chunk, segment):
    rows = ladders.chunk_plan(spark.createDataFrame([(float(duration), float(chunk), float(segment))], "duration double, chunk double, segment double")).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows)))
    at = 0.0
    for r in rows:
        assert r.start == pytest.approx(at, abs=1e-3) and r.length > 0
        at = r.start + r.length
        if r is not rows[-1]:
            assert r.length % 6 == pytest.approx(0, abs=1e-3) or segment not in (1, 2, 3, 4, 5, 6, 10, 12)
    assert at == pytest.approx(duration, abs=1e-3)
    n = ladders.chunk_counts(spark.createDataFrame([(float(duration), float(chunk), float(segment))], "duration double, chunk double, segment double")).first().n
    assert n == len(rows)


def test_reference_run_of_the_cost_model(spark):
    r = spark.range(1).select(cost.machine_hours(F.lit(14.56), F.lit(48.0), F.lit(116.0), F.lit(0.91)).alias("m")).select("m", cost.idle_fraction(F.lit(14.56), F.col("m")).alias("idle"), cost.idle_fraction(F.lit(0.08), cost.machine_hours(F.lit(0.08), F.lit(16.0), F.lit(116.0), F.lit(0.91))).alias("smoke")).first()
    assert abs(r.m - 17.88) < 0.4 and 0.15 <= r.idle <= 0.20 and r.smoke >= 0.8


def test_overhead_model_learns_and_assumes(spark):
    cols = "run long, account string, started_at long, ended_at long, machine double, allocated double, fleet_vcpu long, edge double, lost_s double, total_s double, saved_usd double"
    run = lambda i, acc, s, e, fleet, edge_s=120: (i, acc, s, e, 10.0 + fleet * edge_s / 3600, 9.0, fleet, fleet * edge_s / 3600, 0.0, 1.0, 0.0)
    rows = [run(1, "a", 0, 10, 48), run(2, "a", 20, 30, 48), run(3, "a", 40, 50, 48), run(4, "a", 60, 80, 48, 900), run(5, "a", 70, 90, 48, 900), run(6, "b", 0, 10, 0)]
    got = {r.account: r for r in cost.overhead_model(spark.createDataFrame(rows, cols)).collect()}
    assert (got["a"].edge_s, got["a"].packing, got["a"].n_edge) == (120.0, 0.9, 3)
    assert (got["b"].edge_s, got["b"].packing, got["b"].n_edge) == (116.0, 0.91, 0)


def test_hull_of_a_published_ladder(spark):
    # fixed values: rates and mean scores of the first rungs of a published 4K ladder audit, and their hull distances
    rows = [(138, 234, 24.74), (339, 360, 38.26), (673, 396, 47.87), (1013, 432, 54.41), (1856, 540, 64.93), (2798, 684, 72.68)]
    df = spark.createDataFrame([("c", *r) for r in rows], "k string, kbps int, height int, vmaf double")
    got = [r.hull_delta for r in curves.hull_delta(df, ["k"]).orderBy("kbps").collect()]
    assert got[0] is None and got[-1] is None
    assert got[1:5] == pytest.approx([4.83, 1.61, 1.64, 1.89], abs=0.011)


def test_bd_rate_of_a_shifted_curve(spark):
    pts = [(c, k * f, 20.0 + 10 * math.log(k)) for c, f in (("h264", 1.0), ("hevc", 0.7)) for k in (100, 200, 400, 900, 2000)]
    r = curves.bd_rate(spark.createDataFrame([("x", *p) for p in pts], "clip string, codec string, kbps double, vmaf double"), ["clip"], "h264").first()
    assert r.codec == "hevc" and r.bd_rate_pct == pytest.approx(-30.0, abs=0.01)


def test_planted_period_and_noise(spark):
    rng = random.Random(6)
    rows = [("pulse", i, 80 + (6 if i % 30 == 0 else 0) - (i % 30) * 0.1 + rng.gauss(0, 0.4)) for i in range(600)] + [("noise", i, 80 + rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "series string, frame long, score double")
    d = series.detrend(df, 61)
    p = {r.series: r.period for r in series.fundamental_period(series.autocorrelation(d, 90)).collect()}
    assert abs(p["pulse"] - 30) <= 1
    s = {r.series: r.significance for r in series.permutation_significance(d, 40, trials=10, value="residual").collect()}
    assert s["pulse"] == 100.0 and s["noise"] < 100.0
    blocks = series.detrend(df, 61, block=100).orderBy("series", "frame").collect()
    assert [r.residual for r in blocks] == pytest.approx([r.residual for r in d.orderBy("series", "frame").collect()])


@pytest.mark.parametrize("curve, want", [([9, 3, 3, 4, 5, 6, 6, 7, 7, 7, 7, 7], "VBV starvation"), ([9, 8.5, 8, 7, 6, 5, 4, 4, 3, 3, 2, 2], "normal drift"), ([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9], "starved key frame")])
def test_pulse_verdicts(spark, curve, want):
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(curve)], "series string, bucket int, mean double")
    assert series.pulse_diagnose(df, 12).first().verdict == want


def test_markers(spark):
    import base64
    import json

    argv = base64.b64encode(json.dumps(["ffmpeg", "-i", "x"]).encode()).decode()
    raw = [
        "[[ENCODER-STAGE key=encode:hevc:720p status=running percent=40.0]]", "[[ENCODER-STAGE key=k status=running percent=0.0]]", "[[ENCODER-FLEET machine=m busy=2]]", "[[ENCODER-NEWKIND a=b]]", "plain",
        '[[ENCODER-PLAN [{"key":"k1","label":"One"}]]]', f"[[ENCODER-ARGV codec=hevc b64={argv}]]", "[[ENCODER-COST exec=e junk spot_usd=x spot_usd=1.5]]",
    ]
    df = markers.classify_marker(markers.parse_marker(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")))
    got = {r.i: r for r in df.collect()}
    assert [got[i].marker_class for i in range(5)] == ["live", "live", "gauge", "record", None]
    assert [got[i].is_heartbeat for i in range(5)] == [True, False, True, False, False]
    assert got[5].plan[0].key == "k1" and got[6].argv == ["ffmpeg", "-i", "x"] and got[7].kv == {"exec": "e", "spot_usd": "1.5"}


def test_keep_windows_and_holds(spark):
    o = spark.createDataFrame([("jobs/1/a", 5, 100), ("jobs/2/a", 5, 100), ("mezz/x/a", 5, 100)], "key string, bytes long, modified long")
    keep = spark.createDataFrame([("jobs/2",)], "prefix string")
    act = lambda age: {r.prefix: r.action for r in retention.staging_gc(o, keep, 1000, age, 10_000).collect()}
    assert act(500) == {"jobs/1": "would-delete", "jobs/2": "skipped", "mezz/x": "skipped"} and set(act(0).values()) == {"skipped"}
    d = spark.createDataFrame([("jobs/12-clip",), ("",)], "prefix string")
    outs = spark.createDataFrame([(1, "jobs/12-clip"), (2, "jobs/12-clip2"), (3, "jobs/12-clip/x")], "output long, s3_prefix string")
    assert {r.output for r in retention.gone_under_prefix(outs, d).collect()} == {1, 3}


def test_live_filter_without_inventory(spark):
    f = spark.createDataFrame([(1,), (2,)], "machine long")
    i = spark.createDataFrame([(1, "running")], "instance long, state string")
    assert fleet.live_fleet_filter(f, None).count() == 2 and fleet.live_fleet_filter(f, i.limit(0)).count() == 2 and fleet.live_fleet_filter(f, i).count() == 1


def test_fragments_are_kept_apart_and_regrouped(spark):
    u = spark.createDataFrame([("t", "a", 2, 1), ("t", "a", 2, 2), ("t", "b", 0, 3)], "track string, media string, d int, pos int")
    assert [(r.media, r.duration) for r in manifests.segment_regroup(u).orderBy("place").collect()] == [("a", 4.0), ("b", 4.0)]


def test_readers(spark, tmp_path):
    (tmp_path / "out1").mkdir()
    (tmp_path / "out1" / "run.json").write_text('{"job_id": "1", "cost": {"total": 2.5}, "new": 1}')
    (tmp_path / "out2").mkdir()
    (tmp_path / "out2" / "run.json").write_text("{broken")
    (tmp_path / "out2" / ".remote.json").write_text('{"s3_prefix": ""}')
    assert [r.job_id for r in files.read_run_records(spark, str(tmp_path)).collect()] == ["1"]
    assert {(r.rel, r.bytes > 0) for r in files.listing(spark, str(tmp_path)).collect()} >= {("out1/run.json", True)}
    assert files.scan_outputs(files.listing(spark, str(tmp_path))).where("name = 'out1'").first().files == 1


def test_scalars(spark):
    r = spark.range(1).select(S.gcd(F.lit(6000), F.lit(2400)).alias("g"), S.lcm(F.lit(6000), F.lit(2400)).alias("l"), S.keyint(F.lit(29.97), F.lit(1.0)).alias("k"), S.frame_rate(F.lit("30000/1001"))[1].alias("den"), S.bitrate_mult(F.lit(101.0)).alias("b"), S.fps_mult(F.lit(31)).alias("f"), S.stage_codec(F.lit("encode:av1:720p")).alias("c"), S.stage_codec(F.lit("package:1")).alias("n")).first()
    assert (r.g, r.l, r.k, r.den, r.b, r.f, r.c, r.n) == (1200, 12000, 30, 1001, 1.5, 2, "av1", None)


def test_argv(spark):
    cases = {
        "ffmpeg -y -i in.mp4 -t 12 -c:v libx264 /tmp/out.mp4": "ffmpeg -y -i <PATH> -t <PATH> -c:v libx264 <PATH>",
        "-r 30000/1001 -vf scale=1280:720/2 out/x.mp4": "-r 30000/1001 -vf scale=1280:720/2 out/x.mp4",
        "-f null s3://b/k http://h/x https://h/x file:x.mp4 ftp://h/x": "-f null <PATH> <PATH> <PATH> <PATH> ftp://h/x",
        "-hide_banner -nostats -stats -nostdin -y": "-hide_banner -nostats -stats -nostdin -y",
        "-crf 20 -progress pipe:1 -stats_period 0.5 -an": "-crf 20 -an",
        "-progress pipe:2 -stats_period": "-progress pipe:2 -stats_period",
        "-i -t 5 -ss -i a -frames:v 9 -passlogfile -passlogfile": "-i <PATH> 5 -ss <PATH> a -frames:v <PATH> -passlogfile <PATH>",
        "": "",
    }
    df = spark.createDataFrame([(k, k.split()) for k in cases], "k string, a array<string>")
    assert {r.k: r.x for r in df.select("k", S.normalize_argv(F.col("a")).alias("x")).collect()} == cases


HEIGHTS = (234, 360, 396, 432, 540, 594, 720, 954, 1080, 1440, 1800, 2160)


def test_reservations(spark):
    want = {
        "h264": [(4, 2048)] * 6 + [(3, 2048)] * 3 + [(2, 3072)] * 3,
        "hevc": [(2, 3072)] * 9 + [(2, 6144)] * 3,
        "av1": [(2, 3072)] * 5 + [(8, 6144)] * 7,
        "vp9": [(2, 3072)] * 5 + [(4, 3072)] * 4 + [(4, 6144)] * 3,
    }
    df = spark.createDataFrame([(c, h) for c in want for h in HEIGHTS], "codec string, height int")
    got = {(r.codec, r.height): (r.v, r.m) for r in df.select("codec", "height", S.vcpu_for(F.col("codec"), F.col("height")).alias("v"), S.memory_for(F.col("codec"), F.col("height")).alias("m")).collect()}
    assert got == {(c, h): x for c, xs in want.items() for h, x in zip(HEIGHTS, xs)}


def test_seed_speeds(spark):
    cases = [("h264", 1080, False, "medium", 30, "ubuntu", 1.5), ("vp9", 1080, False, "medium", 30, "", 0.14), ("hevc", 2160, True, "slow", 60, "macmini", 0.14 / 4 * 0.5 / 2 / 2 * 0.8), ("av1", 0, False, "fast", 0, "graviton", 0.1 * 1.3 * 0.7), ("av1", 4320, True, "veryslow", 120, "mac", 0.001), ("h264", -5, False, "odd", -1, "mac", 1.2)]
    df = spark.createDataFrame(cases, "c string, h int, t boolean, p string, f int, m string, want double")
    for r in df.withColumn("got", S.seed_speed(*(F.col(x) for x in "chtpfm"))).withColumn("mult", S.fps_mult(F.col("f"))).collect():
        assert r.got == pytest.approx(r.want) and r.mult == {30: 1, 60: 2, 0: 1, 120: 4, -1: 1}[r.f]


def test_names_and_dims(spark):
    df = spark.createDataFrame([("c7g.4xlarge", 3841, 2161, 16), ("m7g.metal", 1921, 1081, 64), ("x", 101, 99, 0), ("c7g.9xlarge", 7680, 4320, 0), (None, 4096, 2160, 0)], "k string, w int, h int, n int")
    w, h = S.compare_dims(F.col("w"), F.col("h"))
    got = df.select("n", S.instance_vcpus(F.col("k")).alias("v"), w.alias("w"), h.alias("h"), S.quality_model(h).alias("q")).collect()
    assert all(r.n == r.v for r in got) and [(r.w, r.h) for r in got] == [(3838, 2160), (1920, 1080), (100, 98), (3840, 2160), (4096, 2160)]
    assert [r.q[:7] for r in got] == ["vmaf_4k", "vmaf_v0", "vmaf_v0", "vmaf_4k", "vmaf_4k"]


def test_splice_makes_no_pairs(spark):
    plan = retention.splice_snapshot(spark.range(9).selectExpr("0L as bucket", "id as fetched_at", "id as bytes"), spark.range(9).selectExpr("0L as bucket", "id as at", "id as listed_bytes"))
    joins = [x for x in plan._jdf.queryExecution().analyzed().toString().split("\n") if "Join" in x]
    assert all("_block" in x for x in joins), "inventories and enumerations meet by bucket alone"
    rng = random.Random(8)
    inv = [(rng.choice([0, 0, 0, 1, None]), rng.choice([None, *range(300)]), rng.choice([None, None, n])) for n in range(400)]
    enum = [(rng.choice([0, 0, 1, None]), rng.choice([None, *range(300)]), n) for n in range(60)]
    out = retention.splice_snapshot(spark.createDataFrame(inv, "bucket long, fetched_at long, bytes long"), spark.createDataFrame(enum, "bucket long, at long, listed_bytes long"), 40)
    want = []
    for b, t, n in set(inv):
        e = max(((a, x) for k, a, x in enum if None not in (b, t, a) and k == b and a <= t), default=(None, None))
        want.append((b, t, e[1] if n is None else n, e[0] if n is None else None))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


# Names as jobs and folders have them.
@pytest.mark.parametrize(
    "name, want",
    [
        ("var-h264-360p-c3-abc", [("encode:h264:360p:chunk3", "h264", "360p", 360, 3)]), ("var-hevc-1080p_2-c012-e-1", [("encode:hevc:1080p_2:chunk12", "hevc", "1080p_2", 1080, 12)]),
        ("var-av1-720p-whole-x", [("encode:av1:720p", "av1", "720p", 720, None)]), ("pkgall-hevc-x", [("package:hevc", "hevc", None, None, None), ("fragments:hevc", "hevc", None, None, None), ("hls:hevc", "hevc", None, None, None)]),
        ("mezz-x", [("mezzanine", None, None, None, None)]), ("audio-x", [("audio", None, None, None, None)]), ("other-x", [(None,) * 5]), ("var-h264-360p-x3-abc", [(None,) * 5]), ("mezz", [(None,) * 5]), (None, [(None,) * 5]),
    ],
)
def test_job_names(spark, name, want):
    got = files.parse_job_names(spark.createDataFrame([(name,)], "name string")).drop("name").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize(
    "name, want",
    [
        ("clip_h264", ("h264", None, None)), ("clip_hevc_p200_20240101", ("hevc", "200ms", None)), ("clip_av1_padblack", ("av1", None, "black")), ("clip_h264_p1000_padpink", ("h264", "1000ms", "pink")),
        ("clip_padblack_p200_h264", ("h264", None, "black")), ("clip_p200x_h264", ("h264", None, None)), ("clip_p_h264", ("h264", None, None)), ("h264", (None, None, None)), ("a_p33", (None, "33ms", None)),
    ],
)
def test_folder_names(spark, name, want):
    assert tuple(files.parse_folder_names(spark.createDataFrame([(name,)], "name string")).first())[1:] == want


def test_rungs_of_unknown_sources_and_overrides(spark):
    rungs = spark.createDataFrame([("l", "hevc", 1, 640, 360, 800), ("l", "hevc", 2, 1920, 1080, 5000), ("l", "av1", 1, 3840, 2160, 9000), ("l", "h264", 1, 1920, 1080, 7000)], "ladder string, codec string, pos int, width int, height int, kbps int")
    asked = spark.createDataFrame([(1, "l", 0), (2, "l", None), (3, "l", 1280)], "request int, ladder string, src_width int")
    got = ladders.resolve_rungs(ladders.codec_ladders(rungs), asked, overrides={1080: 4321}).collect()
    of = lambda n: sorted((r.codec, r.height, r.kbps) for r in got if r.request == n)
    every = [("av1", 360, 800), ("av1", 1080, 4321), ("h264", 1080, 4321), ("hevc", 360, 800), ("hevc", 1080, 4321)]
    assert of(1) == of(2) == every and of(3) == [("av1", 360, 800), ("hevc", 360, 800)]


def test_host_counters_keep_their_baseline(spark):
    # 14 busy seconds of 4 a second at 3 s, then a reading too soon after it
    rows = [("m", float(t), i, idle, total) for i, (t, idle, total) in enumerate([(0, 0.0, 0.0), (3, 10.0, 24.0), (4, 10.0, 32.0), (7, 20.0, 56.0), (9, 1.0, 8.0), (12, 4.0, 20.0)])]
    got = fleet.host_counter_rate(spark.createDataFrame(rows, "machine string, ts double, seq long, idle double, total double"), 8, 2.0).collect()
    assert [(r.seq, r.busy) for r in got] == [(1, 4.6667), (3, 5.5), (5, 6.0)]


def test_audit_by_name_and_newest(spark):
    o = spark.createDataFrame([(1, "a_h264", "s", "h264", False, 5), (2, "a_h264_x", "t", "h264", False, 9), (3, "a_hevc", "s", "hevc", False, 1), (4, "b_h264", "s", "h264", False, 99), (5, "a_burn", "s", "h264", True, 100), (6, "a_lost", "gone", "av1", False, 1)], "output int, name string, source string, codec string, burnin boolean, mtime long")
    s = spark.createDataFrame([("s",), ("t",)], "source string")
    why = lambda **x: {r.output: r.reason for r in curves.audit_tree(o, s, **x).collect()}
    assert why() == {1: None, 2: None, 3: None, 4: None, 5: "burn-in", 6: "no source"}
    assert why(match="a_", latest=True) == {1: "older", 2: None, 3: None, 5: "burn-in", 6: "no source"}


def test_frame_pool_without_scores(spark):
    f = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 50.0)], "series long, frame long, score double")
    p = spark.createDataFrame([(2, 9.0, None, None, None), (3, 80.0, None, 40.0, None), (4, None, None, None, None)], "series long, mean double, harmonic double, low double, high double")
    got = {r.series: r for r in curves.frame_pool(f, p).collect()}
    assert set(got) == {1, 2, 3} and got[1].harmonic == 0.0 and got[2].n == 1
    assert tuple(got[3])[1:] == (0, 80.0, 80.0, 40.0, -1, 40.0, 80.0, 0.0, 0.0, 0.0)


def test_attempts(spark):
    rows = [("j", "k", "Host EC2 (instance i) terminated.", 10, 40), ("j", "k", "x Was Terminated", 50, 45), ("j", "k", "done", 100, 160), ("j", "k", None, 200, None), ("j", "k", "Host EC2 x", None, 9)]
    got = cost.attempt_reclaims(spark.createDataFrame(rows, "job string, key string, reason string, started long, stopped long"), 260).first()
    assert (got["count"], got.lost_s, got.total_s) == (3, 30.0, 30 + 210 + 60 + 60)


def test_commands_are_split_as_a_shell_does(spark):
    import shlex

    rng = random.Random(11)
    parts = ["a", "-vf", " ", "  ", "'", '"', "\\", "\\\\", '\\"', "x y", "é", "\t", "=", "'q r'", '"s \\" t"', "''", "/out/h264_720_c1.mp4"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1000)] + ["", " ", "ffmpeg " + "-x 'y z' " * 2000]
    got = {r.i: r.w for r in spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", S.split_command("line").alias("w")).collect()}
    for i, line in enumerate(lines):
        try:
            want = shlex.split(line)
        except ValueError:
            want = None
        assert got[i] == want, line


def test_newest_logs_alone_are_read(spark, tmp_path):
    import os

    for i in range(6):
        p = tmp_path / f"run{i}.log"
        p.write_text(f"line {i}\n")
        os.utime(p, (1000 + i, 1000 + i))
    (tmp_path / "other.txt").write_text("no\n")
    df = files.read_newest_logs(spark, str(tmp_path), 2)
    assert sorted(r.line for r in df.collect()) == ["line 4", "line 5"] and len(df.inputFiles()) == 2


def test_registered_kinds_have_typed_fields(spark):
    markers.register_marker("SPEED", "machine string, height int, fps double")
    try:
        df = markers.parse_marker(spark.createDataFrame([("[[ENCODER-SPEED machine=m height=720 fps=x more=1]]",), ("[[ENCODER-COST a=b]]",)], "raw string"))
        got = df.collect()
        assert tuple(got[0].speed) == ("m", 720, None) and got[0].kv["more"] == "1" and got[1].speed is None
    finally:
        markers.FIELDS.pop("SPEED")


def test_sql_functions_are_the_columns(spark, data):
    from encodelens.functions import sql
    from encodelens.plans.views import Views

    assert "stage_codec" in sql.register(spark)
    Views(spark, data).stages.createOrReplaceTempView("stages_of_test")
    df = spark.sql("select stage_codec(key) as c, phase_key(key) as p, is_backup(concat(job, '_20240101')) as b, stage_rank(status) as r, rendered_width(status, percent) as w, key, status, percent from stages_of_test")
    want = df.select(S.stage_codec("key").alias("c"), S.phase_key("key").alias("p"), stages.rank(F.col("status")).alias("r"), stages.rendered_width(F.col("status"), F.col("percent")).alias("w"))
    assert df.select("c", "p", "r", "w").exceptAll(want).isEmpty() and df.where("not b").isEmpty()
    assert "Python" not in df._jdf.queryExecution().toString()


def test_plan_bytes_are_those_of_the_plan(spark):
    import json

    rng = random.Random(17)
    rows = [(round(rng.choice([5, 59, 334.4, 3600, 20_000.25, 50_000]) * (1 + rng.random()), 3), rng.choice([1.0, 12.0, 30.0, 47.5, 240.0, 99999.0]), 6.0) for _ in range(40)]
    rows += [(12.0, 12.0, 6.0), (13.0, 12.0, 6.0), (60_000.0, 6.0, 6.0), (6.0, 6.0, 6.0), (61.9, 12.0, 6.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, duration double, chunk double, segment double")
    spans = {}
    for r in ladders.chunk_plan(df).orderBy("i", "index").collect():
        spans.setdefault(r.i, []).append({"index": r["index"], "start_s": f"{r.start:.6f}", "duration_s": f"{r.length:.6f}"})
    got = df.select("i", ladders.plan_bytes(F.col("duration"), F.col("chunk"), ladders.grid(F.col("segment"))).alias("b")).collect()
    assert {r.i: r.b for r in got} == {i: len(json.dumps(s, separators=(",", ":"))) for i, s in spans.items()}


# The cases of the guard's own tests.
@pytest.mark.parametrize("hours, chunk, want", [(1, 12.0, None), (2.8, 12.0, None), (0.2, 12.0, None), (12, 12.0, "history and input"), (20, 18.0, "history and input"), (9, 10.3, "history")])
def test_plan_fit(spark, hours, chunk, want):
    rungs = spark.createDataFrame([(1, hours * 3600.0, chunk, "hevc", 1080)], "request int, duration double, chunk double, codec string, height int")
    r = ladders.plan_fit(rungs).first()
    assert r.fails == want and r.events == 8 * r.chunks and r.peak_vcpu == r.chunks * 2
    assert r.advice_s == 30


def loop_estimate(points, clip, height, kbps):
    """The estimate by a loop over all points of the clip."""
    mine = [(h, k, v) for c, h, k, v in points if c == clip and k is not None and v is not None]
    own = [p for p in mine if height is not None and p[0] == height]
    if len(own) >= 2 or len(own) == 1 and own[0][1] == kbps:
        mine = own
    lo, hi = [(k, v) for _, k, v in mine if k <= kbps], [(k, v) for _, k, v in mine if k >= kbps]
    if not mine:
        return None, False
    if not lo or not hi:
        return (max(lo) if lo else min(hi))[1], True
    (a, x), (b, y) = max(lo), min(hi)
    return (x if a == kbps else x + (y - x) * (kbps - a) / (b - a)), False


def test_curve_estimate_against_a_loop(spark):
    """Any order of rates, repeated points and questions, a null height, rate or score, clips without points."""
    rng = random.Random(5)
    points = [(f"c{rng.randrange(4)}", rng.choice([360, 720, 1080, None]), rng.choice([None, *range(100, 1000, 50)]), rng.choice([None, *[x / 4 for x in range(160, 400)]])) for _ in range(60)]
    points += [("hot", 720, 500, 70.0)] * 3 + [("one", 720, 500, 70.0), ("one", 360, 200, 50.0)]
    asked = [(i, rng.choice(["c0", "c1", "c2", "c3", "hot", "one", "none"]), rng.choice([360, 720, 1080, 2160, None]), rng.choice([None, *range(50, 1100, 25)])) for i in range(300)]
    asked.append(asked[0])
    p = spark.createDataFrame(points, "clip string, height int, kbps int, vmaf double").selectExpr("clip", "'h' as codec", "0 as reference", "height", "kbps", "vmaf")
    q = spark.createDataFrame(asked, "rung int, clip string, height int, kbps int").selectExpr("rung", "clip", "'h' as codec", "0 as reference", "height", "kbps")
    got = sorted((r.rung, r.vmaf, r.clamped) for r in curves.curve_estimate(q, p).collect())
    want = []
    for i, clip, height, kbps in asked:
        v, clamped = (None, False) if kbps is None else loop_estimate(points, clip, height, kbps)
        want.append((i, v, clamped))
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in sorted(want)]
    assert all(a is None and b is None or a == pytest.approx(b, abs=6e-5) for (_, a, _), (_, b, _) in zip(got, sorted(want)))
    assert curves.curve_estimate(q.limit(0), p).count() == 0
    assert {r.vmaf for r in curves.curve_estimate(q, p.limit(0)).collect()} == {None}


@pytest.mark.parametrize("block_s", [1, 37, 900])
def test_rental_totals_are_the_sums_of_the_rentals(spark, block_s):
    """Launches at the very ends of a span, many at one second, boxes that never ended or never launched, null execs."""
    rng = random.Random(9)
    boxes = [(i, rng.choice([2, 4, 8]), rng.choice([None, 880, 1000, 1120, *range(0, 4000, 40)]), rng.choice([None, *range(3000, 6000, 50)])) for i in range(120)]
    jobs = [(rng.choice(["a", "b", "c", None]), rng.randrange(30), s, rng.choice([None, s + 500]), 2) for s in (rng.randrange(1000, 3000) for _ in range(40))]
    j = spark.createDataFrame(jobs, "exec string, instance int, start_s long, stop_s long, vcpu int")
    b = spark.createDataFrame(boxes, "instance int, vcpu int, launch long, ended long")
    want = {}
    for r in cost.machine_rental(j, b, 5000).collect():
        w = want.setdefault(r.exec, [0, 0, 0, 0])
        for i, x in enumerate((1, r.jobs == 0, r.rented_vcpu_s or 0, r.allocated_vcpu_s)):
            w[i] += x
    got = {r.exec: [r.boxes, r.unused, r.rented_vcpu_s or 0, r.allocated_vcpu_s] for r in cost.rental_totals(j, b, 5000, block_s=block_s).collect()}
    assert got == want and any(w[1] for w in want.values())
    assert cost.rental_totals(j, b.limit(0), 5000).count() == 0


def test_batch_source(spark):
    """Several files with a limit a file; unknown durations count for the limit alone; the first known width."""
    rows = [
        ("sum", 0, 100.0, 1920, 30, None), ("sum", 1, 50.0, 1280, 60, None), ("cap", 0, 100.0, 1920, 30, "20"), ("cap", 1, None, 1280, 60, "20"), ("cap", 2, -1.0, 1280, 60, "20"),
        ("long", 0, 10.0, 1920, 30, "20"), ("long", 1, 15.0, 1920, 30, "20"), ("bad", 0, 10.0, 0, 24, "x"), ("bad", 1, 10.0, 1280, 60, "x"), ("none", 0, 0.0, 1920, 30, None),
        ("blind", 0, 10.0, 0, 24, "0"), ("blind", 1, 10.0, None, 60, "0"), ("blind", 2, None, 1920, 50, "0"),
    ]
    got = ladders.batch_source(spark.createDataFrame(rows, "request string, pos int, duration double, width int, fps int, limit_s string")).collect()
    assert {r.request: (r.duration, r.src_width, r.fps, r.files) for r in got} == {
        "sum": (150.0, 1920, 30, 2), "cap": (60.0, 1920, 30, 3), "long": (25.0, 1920, 30, 2), "bad": (20.0, 1280, 60, 2), "blind": (20.0, 0, 60, 3),
    }


def test_rung_groups_give_the_figures_of_their_rungs(spark):
    """A request meets a row per size of its ladder, whatever the number of its rungs, and every summed figure stays."""
    sizes = [("h264", 640, 360), ("hevc", 1280, 720), ("hevc", 1920, 1080), ("av1", 3840, 2160)]
    rungs = spark.createDataFrame([("L", *sizes[i % 4], i, 100 + i) for i in range(400)], "ladder string, codec string, width int, height int, pos int, kbps int")
    asked = [(1, "L", 1920, 700.0, 30, True, 60.0, True), (2, "L", 0, 95.5, 60, False, 20.0, False), (3, "L", 640, 5000.0, 24, False, 20.0, True)]
    requests = spark.createDataFrame(asked, "request int, ladder string, src_width int, duration double, fps int, two_pass boolean, src_mbps double, has_audio boolean")
    learned = spark.createDataFrame([("graviton", "hevc", 720, 2.5, 3), ("mac", "h264", 360, 0.7, 2)], "machine string, codec string, height int, speed double, n long")
    one, many = ladders.resolve_rungs(rungs, requests), ladders.for_requests(ladders.rung_groups(rungs), requests)
    assert many.count() == 3 + 4 + 1
    figures = [
        lambda r: ladders.saas_quote(r, ladders.rates(spark)), lambda r: ladders.cloud_quote(ladders.with_speed(r, learned, "graviton")), lambda r: ladders.local_makespan(ladders.with_local_speed(r, learned)),
        lambda r: ladders.chunk_budget_sweep(ladders.with_speed(r, learned, "graviton"), budget=300), lambda r: ladders.plan_fit(r.withColumn("chunk", F.lit(12.0))),
    ]
    for f in figures:
        a, b = [sorted(map(tuple, f(r).collect()), key=str) for r in (one, many)]
        assert a and [[pytest.approx(x, abs=2e-4) if isinstance(x, float) else x for x in r] for r in a] == [list(r) for r in b]


def test_quotes_meet_the_sizes_of_a_ladder(spark, data):
    from encodelens.plans import cost_queries
    from encodelens.plans.views import Views

    v = Views(spark, data)
    met = cost_queries.grouped(v)
    sizes = v.rungs.select("ladder", "codec", "width", "height").distinct().groupBy("ladder").count()
    assert met.groupBy("request").count().agg(F.max("count")).first()[0] <= sizes.agg(F.max("count")).first()[0]
    assert met.agg(F.sum("n")).first()[0] == v.requests.join(v.rungs, "ladder").where("width <= src_width").count()


def test_trials_send_no_table_through_the_driver(spark):
    """Tables with a row a series or trial grow with the input; copies keep the mean, so a loop over them agrees."""
    rng = random.Random(5)
    scores = {n: [rng.random() + (f % 4 == 0) * (n % 2) for f in range(40 + n)] for n in range(6)}
    frames = spark.createDataFrame([(n, f, x) for n, xs in scores.items() for f, x in enumerate(xs)], "series int, frame int, score double")
    out = series.permutation_significance(frames, 8, trials=5, block=16)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    order = frames.select("series", "frame", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("trial")).select("series", "trial", "frame", F.xxhash64(F.lit(1), "trial", "frame").alias("h"))
    at = {}
    for r in order.orderBy("h").collect():
        at.setdefault((r.series, r.trial), []).append(r.frame)

    def most(xs):
        m = sum(xs) / len(xs)
        d = [x - m for x in xs]
        return max(round(sum(a * b for a, b in zip(d, d[lag:])) / sum(a * a for a in d), 6) for lag in range(2, 9))

    for r in out.collect():
        xs = scores[r.series]
        assert r.observed == pytest.approx(most(xs), abs=2e-6)
        assert r.significance == 100 * sum(most([xs[f] for f in at[r.series, t]]) < most(xs) for t in range(1, 6)) / 5


def test_audit_covers_all_outputs(spark, data):
    from encodelens.plans.catalog import QUERIES
    from encodelens.plans.views import Views

    assert QUERIES["O103_audit_tree"](spark, data).count() == Views(spark, data).outputs.count()


def test_seed_weights_are_rounded_once(spark):
    """10.5 percent at h264 and 1080 lines over a speed of 1.5 is 7, and 540 lines weigh a quarter of that, both exactly."""
    rows = spark.createDataFrame([("h264", 1080, 10.5), ("h264", 540, 10.5), ("av1", 20000, 10.5)], "codec string, height int, pct double")
    got = [r[0] for r in rows.select(S.seed_weighted(F.col("pct"), F.col("codec"), F.col("height"))).collect()]
    assert got == [7.0, 1.75, 10500.0]


def test_wall_ranks_of_tied_sizes(spark):
    """Sizes that tie interleave by position, hevc goes before others that tie, and no pair of a request is shuffled."""
    sizes = [("h264", 640, 360, 2.0), ("av1", 1280, 720, 2.0), ("hevc", 1280, 720, 2.0), ("h264", 1920, 1080, 0.5)]
    rungs = spark.createDataFrame([("L", *sizes[i % 4][:3], i, 100) for i in range(80)], "ladder string, codec string, width int, height int, pos int, kbps int")
    requests = spark.createDataFrame([(1, "L", 1920, 60.0), (2, "L", 1280, 90.0)], "request int, ladder string, src_width int, duration double")
    speed = spark.createDataFrame([(c, h, s) for c, _, h, s in sizes], "codec string, height int, speed double")
    groups = ladders.for_requests(ladders.rung_groups(rungs), requests).join(speed, ["codec", "height"])
    got = sorted((r.request, r.rank, r.pos, r.wall_s) for r in ladders.predicted_wall_rank(groups, rungs).collect())
    want = []
    for request, width, duration in ((1, 1920, 60.0), (2, 1280, 90.0)):
        one = sorted((-duration / sizes[i % 4][3], sizes[i % 4][0] != "hevc", i) for i in range(80) if sizes[i % 4][1] <= width)
        want += [(request, n, i, -w) for n, (w, _, i) in enumerate(one, 1)]
    assert got == want


def test_all_pairs_are_made_by_many_tasks(spark):
    rungs = spark.range(400).selectExpr("'L' as ladder", "'h264' as codec", "id as pos", "640 as width", "360 as height", "1 as kbps")
    requests = spark.range(20).selectExpr("id as request", "'L' as ladder", "640 as src_width")
    out = ladders.resolve_rungs(rungs, requests)
    assert out.count() == 8000 and out.select("request", "pos").distinct().count() == 8000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan and "BroadcastExchange" not in plan


def test_progress_is_rounded_as_in_sql(spark, tmp_path, same):
    """Jobs whose hours to go are near a tie of the third digit equal the SQL, with rows in either order (F1)."""
    import duckdb

    from encodelens.plans.catalog import ORACLES, QUERIES

    jobs = {
        47281: [("N", 1, 23, 0.1, 831859200), ("N", 5, 36, 0.0, 905385600), ("A", 7, 2, 0.1, 908668800)],
        62958: [("N", 3, 12, 0.0, 978480000), ("A", 5, 38, 0.05, 954201600)],
        138616: [("R", 2, 18, 0.02, 835660800), ("N", 2, 3, 0.02, 962150400), ("N", 3, 32, 0.02, 908064000), ("R", 4, 29, 0.1, 920419200)],
    }
    lines = [(j, 1, 1, n, float(q), 9.0, d, 0.0, f, "O" if d == 0 and f == "N" and n == 3 else "F", at) for j, some in jobs.items() for f, n, q, d, at in some]
    orders = spark.createDataFrame([(j, 1) for j in jobs], "o_orderkey long, at long").select("o_orderkey", F.timestamp_seconds("at").alias("o_orderdate"))
    for name, some in (("a", lines), ("b", lines[::-1])):
        li = spark.createDataFrame(some, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, at long")
        li.withColumn("l_shipdate", F.timestamp_seconds("at")).drop("at").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        orders.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        con = duckdb.connect()
        con.execute("set TimeZone = 'UTC'")
        for t in ("lineitem", "orders"):
            con.execute(f"create view {t} as select * from '{tmp_path}/{name}/{t}.parquet/*.parquet'")
        got = QUERIES["O76_weighted_progress"](spark, f"{tmp_path}/{name}")
        same(got, con, ORACLES["O76_weighted_progress"])
        assert {r.job: r.eta_h for r in got.collect() if r.job != 138616} == {47281: 52734.184, 62958: 487135.688}
