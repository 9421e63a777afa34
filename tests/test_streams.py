"""Folds in blocks, streams and the tables that they keep against loops and batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from encodelens.operators import fleet, stages
from encodelens.streaming import path, state, stateful
from encodelens.streaming.store import CappedLog, KeyedStore

EVENTS = "seq long, key string, status string, percent double, src string"


@pytest.fixture
def one_store(spark):
    """A session for streams: RocksDB, one partition, no batches without data."""
    conf = stateful.CONF | {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed(spark, tmp_path, df, part):
    df.where(F.col("batch") == part).drop("batch").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run_stream(spark, tmp_path, f, schema, put=None, mode="append", idle=False):
    """f over what is new in the folder, a file a micro-batch; rows of each batch are put or kept.

    idle: run batches without data, for timers of event time; those of processing time would make them run for ever.
    """
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())
    got = []
    put = put or (lambda b, n: got.extend(b.collect()))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = f(s).writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return got


def loop_fold(events):
    old, pct, out = None, 0.0, []
    rank = {"pending": 0, "queued": 1, "starting": 2, "running": 3, "reclaimed": 3, "failed": 4, "done": 5}
    for seq, new, p, src in sorted(events):
        back = old is not None and old != "failed" and new not in ("failed", "reclaimed") and rank.get(new, 0) < rank.get(old, 0)
        ok = not (old == "done" and new != "done" or back)
        if ok:
            p = pct if p is None else p
            if old == new != "done" and p < pct:
                p = pct
            old, pct = new, p
        out.append((seq, ok, old, pct))
    return out


def random_events(seed, keys=3, n=400):
    rng = random.Random(seed)
    names = [*stages.RANK, "skipped", "odd"]
    weights = [3, 3, 3, 9, 2, 2, 0.3, 1, 1]
    # one key has most of the events
    return [(i, f"k{0 if rng.random() < 0.7 else rng.randrange(keys)}", rng.choices(names, weights)[0], rng.choice([None, 0.0, 10.0, 40.0, 90.0]), rng.choice("ab")) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_stage_fold_in_blocks_is_the_loop(spark, seed):
    ev = random_events(seed)
    got = {}
    for r in stages.stage_state_fold(spark.createDataFrame(ev, EVENTS), rows_a_block=23).collect():
        got.setdefault(r.key, []).append((r.seq, r.accepted, r.status, r.percent))
    assert set(got) == {e[1] for e in ev}
    for k in got:
        assert sorted(got[k]) == loop_fold([(s, st, p, src) for s, key, st, p, src in ev if key == k])


def test_a_hot_key_is_spread_over_tasks(spark):
    ev = spark.createDataFrame(random_events(9, n=600), EVENTS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few here
    tasks = stages.stage_state_fold(ev, rows_a_block=50).where("key = 'k0'").select(F.spark_partition_id()).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def throttled(rows, gap):
    last, kept = {}, []
    for m, ts, seq in sorted(rows):
        if m not in last or ts - last[m] >= gap:
            last[m] = ts
            kept.append(seq)
    return sorted(kept)


@pytest.mark.parametrize("gap, span, rows_a_block", [(3, 100, 11), (3, 2000, 7), (40, 300, 9), (3, 100, 1000)])
def test_throttle_in_blocks(spark, gap, span, rows_a_block):
    rng = random.Random(gap + span)
    rows = sorted((rng.randrange(3), rng.randrange(span), i) for i in range(150))
    df = spark.createDataFrame(rows, "machine long, ts long, seq long")
    assert sorted(r.seq for r in fleet.fleet_throttle(df, gap, rows_a_block=rows_a_block).collect()) == throttled(rows, gap)


@pytest.mark.parametrize("rows_a_block", [9, 1000])
def test_speed_in_blocks(spark, rows_a_block):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), "h264", 720, i, rng.choice([0.0, -1.0, None, *[rng.random() * 5 for _ in range(6)]])) for i in range(200)]
    want = {}
    for m, _, _, _, x in rows:
        if x and x > 0:
            s, n = want.get(m, (0, 0))
            want[m] = (x if not n else 0.7 * s + 0.3 * x, n + 1)
    got = fleet.speed_ewma(spark.createDataFrame(rows, "machine string, codec string, height int, seq long, speed double"), rows_a_block=rows_a_block)
    assert {r.machine: (pytest.approx(r.speed, abs=1e-9), r.n) for r in got.collect()} == want


def packets(rows, most, flush):
    out, held = [], {}
    for pub, seq, sent, beat in sorted(rows):
        h = held.setdefault(pub, [])
        if h and sent - h[0][1] >= flush:
            out.append((pub, len(h), h[0][0], h[-1][0]))
            h.clear()
        h.append((seq, sent))
        if len(h) == most or not beat:
            out.append((pub, len(h), h[0][0], h[-1][0]))
            h.clear()
    return sorted(out + [(p, len(h), h[0][0], h[-1][0]) for p, h in held.items() if h])


def beats(seed, n=300):
    rng = random.Random(seed)
    rows, now = [], 0
    for i in range(n):
        now += rng.choice([0, 0, 0, 1, 1, 2, 5])
        rows.append((rng.choice([1, 1, 1, 2]), i, now, rng.random() < 0.85))
    return rows


@pytest.mark.parametrize("seed, rows_a_block, most, flush", [(1, 1000, 10, 3), (1, 13, 10, 3), (2, 5, 10, 3), (3, 4, 6, 100), (4, 3, 10, 1000)])
def test_heartbeats_in_blocks_are_the_loop(spark, seed, rows_a_block, most, flush):
    rows = beats(seed)
    df = spark.createDataFrame(rows, "publisher long, seq long, sent long, is_heartbeat boolean")
    assert sorted(map(tuple, state.heartbeat_compaction(df, most, flush, rows_a_block).collect())) == packets(rows, most, flush)


# The cases of the sender's own tests: a full packet goes at 10, an event goes at once with what waits, order is kept.
@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, i, 0, True) for i in range(10)], [(1, 10, 0, 9)]), ([(1, 0, 0, True), (1, 1, 0, False)], [(1, 2, 0, 1)]), ([(1, 0, 0, False)], [(1, 1, 0, 0)]),
        ([(1, 0, 0, True), (1, 1, 3, True)], [(1, 1, 0, 0), (1, 1, 1, 1)]), ([(1, 0, 0, True), (1, 1, 2, True), (1, 2, 3, False)], [(1, 1, 2, 2), (1, 2, 0, 1)]),
    ],
)
def test_heartbeat_cases(spark, rows, want):
    df = spark.createDataFrame(rows, "publisher long, seq long, sent long, is_heartbeat boolean")
    assert sorted(map(tuple, state.heartbeat_compaction(df).collect())) == sorted(want)


def test_heartbeat_stream_is_the_batch(one_store, tmp_path):
    rows = [(*r, r[1] // 100) for r in beats(5)]
    last = rows[-1][2]
    rows += [(9, 1000, last + 50, False, 3), (9, 1001, last + 51, False, 4)]  # time goes on, so that what waits is sent
    df = one_store.createDataFrame(rows, "publisher long, seq long, sent long, is_heartbeat boolean, batch int")
    for n in range(5):
        feed(one_store, tmp_path, df, n)
    got = run_stream(one_store, tmp_path, stateful.heartbeat_stream, df.drop("batch").schema, idle=True)
    assert sorted(map(tuple, got)) == packets([r[:4] for r in rows], 10, 3)


def test_stage_fold_and_speed_streams_are_the_batch(one_store, tmp_path):
    ev = one_store.createDataFrame(random_events(2, n=90), EVENTS)
    for n in range(3):
        feed(one_store, tmp_path, ev.withColumn("batch", F.expr("seq div 30")), n)
    got = run_stream(one_store, tmp_path, stateful.stage_fold_stream, ev.schema)
    key = lambda r: (r.key, r.seq, r.accepted, r.status, r.percent)
    assert sorted(map(key, got)) == sorted(map(key, stages.stage_state_fold(ev).collect()))


def test_speed_stream_is_the_batch(one_store, tmp_path):
    df = one_store.createDataFrame([("m", "h264", 720, i, float(i * 7 % 5) - 0.5) for i in range(60)], "machine string, codec string, height int, seq long, speed double")
    for n in range(3):
        feed(one_store, tmp_path, df.withColumn("batch", F.expr("seq div 20")), n)
    got = run_stream(one_store, tmp_path, stateful.speed_ewma_stream, df.schema, mode="update")[-1]
    want = fleet.speed_ewma(df).first()
    assert got.n == want.n and got.speed == pytest.approx(want.speed, abs=1e-9)


def test_replay_guard_stream_is_the_batch(one_store, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.choice([0, None, i // 2, i, i]), i, rng.choice(["record", "gauge", "live"])) for i in range(1, 91)]
    ev = one_store.createDataFrame(rows, "publisher long, event long, seq long, arrival long, marker_class string")
    for n in range(3):
        feed(one_store, tmp_path, ev.withColumn("batch", F.expr("(event - 1) div 30")), n)
    got = run_stream(one_store, tmp_path, stateful.replay_guard_stream, ev.schema)
    want = state.replay_guard(ev).collect()
    assert sorted((r.event, r.replay) for r in got) == sorted((r.event, r.replay) for r in want)


PANEL = "machine string, ts long, seq long, busy double, perf double, version string, chunks string"


def test_fleet_panel_stream_is_the_view_after_each_batch(one_store, tmp_path):
    spark, rng = one_store, random.Random(8)
    rows = []
    for i in range(160):
        ts = 1000 + i * 2 + rng.randrange(2)
        m = rng.choice(["a", "b", "c"] if i < 60 else ["a", "b"])  # c falls silent
        rows.append((m, ts, i, rng.random() * 8, rng.choice([4.0, 8.0]), rng.choice([None, "", "v1", "v2"]), f"x{i}|y", i // 40))
    df = spark.createDataFrame(rows, PANEL + ", batch int")
    store = KeyedStore(spark, str(tmp_path / "panel"), ["machine"], "order", buckets=4, gone="gone")
    order = F.struct("ts", F.col("gone").cast("int").alias("gone"), "asked")
    for n in range(4):
        feed(spark, tmp_path, df, n)
        run_stream(spark, tmp_path, lambda s: stateful.fleet_panel_stream(s, ring=10, ttl_s=60).withColumn("order", order), df.drop("batch").schema, store.put, "update", idle=True)
        so_far = df.where(F.col("batch") <= n).drop("batch")
        now = so_far.agg(F.max("ts")).first()[0]
        want = fleet.fleet_view(so_far, now, 60, ring=10).collect()
        got = {r.machine: r for r in store.table().collect()}
        assert set(got) == {r.machine for r in want}
        for r in want:
            g = got[r.machine]
            assert (now - g.ts, g.used_pct, g.samples, g.history, g.chunks, g.version, g.first_seen) == (r.age_s, r.used_pct, r.samples, r.history, r.chunks, r.version, r.first_seen)
            assert g.mean_pct == pytest.approx(r.mean_pct, abs=2e-4)
    assert "c" not in got


def test_registers_in_any_order(spark):
    rng = random.Random(2)
    kinds = ["STAGE"] * 4 + ["HOST", "TIMING", "REUSED"]
    rows = []
    for i in range(1, 200):
        k, kind = f"k{rng.randrange(8)}", rng.choice(kinds)
        f = {"STAGE": (rng.choice(["pending", "running", "done", "failed"]), float(i), None, None, None), "HOST": (None, None, f"i{i}", rng.choice([None, "", f"v{i}"]), None), "TIMING": (None, None, None, None, float(i)), "REUSED": (None,) * 5}[kind]
        rows.append((k, i, kind, 1000 + i, *f, f[4], f[4]))
    schema = "key string, seq long, kind string, sent long, status string, percent double, instance string, version string, cpu_s double, total_s double, mem_mib double"
    want = {}
    for k, seq, kind, sent, status, percent, instance, version, cpu, _, _ in rows:
        r = want.get(k)
        if r is None:
            if kind not in ("STAGE", "REUSED"):
                continue
            r = want[k] = dict(started=None, ended=None, status="pending", percent=0.0, instance=None, version=None, cpu_s=None, reused=False)
        if kind == "STAGE":
            r["started"] = sent if r["started"] is None and status == "running" else r["started"]
            r["ended"] = sent if r["ended"] is None and status in ("done", "failed") else r["ended"]
            r["status"], r["percent"] = status, percent
        elif kind == "HOST":
            r["instance"], r["version"] = instance, version or r["version"]
        elif kind == "TIMING":
            r["cpu_s"] = cpu
        else:
            r["reused"] = True
    for order in range(3):
        some = rows[:]
        random.Random(order).shuffle(some)
        cuts = [some[:50], some[50:120], some[120:]]
        parts = [stages.registers(spark.createDataFrame(c, schema)) for c in cuts]
        inner = stages.merge_registers(parts[0].unionByName(parts[1]))
        got = stages.stage_rows(stages.merge_registers(inner.unionByName(parts[2]))).collect()
        assert {r.key: {c: r[c] for c in want[r.key]} for r in got} == want


def test_keyed_store(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "t"), ["key"], "seq", buckets=8, gone="gone")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, seq long, status string, gone boolean")
    s.put(rows(*[(f"k{i}", i, "queued", False) for i in range(40)], (None, 5, "null key", False)), 0, "a")
    kind, had, at = s.follow("page")
    assert kind == "list" and had.count() == 41
    s.acknowledge("page", at)
    before = s._state()[1]["buckets"]
    s.put(rows(("k1", 100, "done", False), ("k1", 90, "running", False), ("k2", 1, "older", False)), 1, "a")
    after = s._state()[1]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1  # of the two keys' buckets, only that of the changed key
    kind, changes, at = s.follow("page")
    assert kind == "changes" and [(r.key, r.status) for r in changes.collect()] == [("k1", "done")]
    s.put(rows(("k1", 100, "done", False)), 1, "a")  # a batch that is run again, and one that changes nothing
    s.put(rows(("k1", 100, "again", False)), 2, "a")
    assert s.changes(at).count() == 0
    # a new checkpoint starts at 0 again, and numbers may be left out
    s.put(rows(("k3", 3, "queued", False), ("new", 1, "queued", False)), 0, "b")
    s.put(rows(("k4", 200, "failed", True)), 7, "b")
    s.put(rows(("k4", 150, "running", False)), 8, "b")  # a replay does not bring a gone key back
    table = {r.key: r.status for r in s.table().collect()}
    assert len(table) == 41 and table["k1"] == "done" and table["new"] == "queued" and "k4" not in table and table[None] == "null key"
    # the list that the reader took, with the changes after it, is the table
    state_of = {r.key: r.status for r in had.collect()}
    for r in sorted(s.changes(s.files.read("_readers", "page.json")["version"]).collect(), key=lambda r: r._version):
        state_of.pop(r.key, None) if r.gone else state_of.update({r.key: r.status})
    assert state_of == table
    s.compact(keep_versions=0)
    assert s.follow("page")[0] == "list"  # a slow reader loses changes and not the state
    assert {r.key: r.status for r in s.table().collect()} == table
    assert len(s.files.names("_manifest")) == 1


def test_keyed_store_after_a_crash(spark, tmp_path, monkeypatch):
    s = KeyedStore(spark, str(tmp_path / "t"), ["key"], "seq", buckets=2)
    rows = lambda *x: spark.createDataFrame(list(x), "key string, seq long, status string")
    s.put(rows(("a", 1, "x"), ("b", 1, "x")), 0, "q")
    with monkeypatch.context() as m:
        m.setattr(s, "_swap", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            s.put(rows(("a", 2, "y")), 1, "q")
    assert {(r.key, r.status) for r in s.table().collect()} == {("a", "x"), ("b", "x")}
    (tmp_path / "t" / "_manifest" / "000000000002.json").write_text('{"buckets": {"0"')  # cut off on the way
    s.put(rows(("a", 2, "y")), 1, "q")
    assert {(r.key, r.status) for r in s.table().collect()} == {("a", "y"), ("b", "x")}
    s.compact()
    assert {(r.key, r.status) for r in s.table().collect()} == {("a", "y"), ("b", "x")} and not s.files.names("incoming")
    with pytest.raises(Exception, match="(?i)exist"):
        s.files.put(s.version(), {})  # a number is written once


def test_keyed_store_by_a_stream_with_a_new_checkpoint(one_store, tmp_path):
    df = one_store.createDataFrame([(f"k{i % 7}", i, str(i), i // 10) for i in range(30)], "key string, seq long, status string, batch int")
    s = KeyedStore(one_store, str(tmp_path / "t"), ["key"], "seq", buckets=4)
    feed(one_store, tmp_path, df, 0), feed(one_store, tmp_path, df, 1)
    run_stream(one_store, tmp_path, lambda x: x, df.drop("batch").schema, s.put)
    (tmp_path / "ck").rename(tmp_path / "lost")
    feed(one_store, tmp_path, df, 2)
    run_stream(one_store, tmp_path, lambda x: x, df.drop("batch").schema, s.put)
    want = {f"k{i % 7}": str(i) for i in range(30)}
    assert {r.key: r.status for r in s.table().collect()} == want


def test_capped_log(spark, tmp_path):
    rng = random.Random(6)
    log = CappedLog(spark, str(tmp_path / "log"), "account", "at", "run", 6)
    rows = []
    for n in range(6):
        part = [(100 * n + i, ["a", "b", "c", "d", None][i % 5] if n != 3 else "z", n * 100 + rng.randrange(70)) for i in range(20)]
        rows += part
        log.append(spark.createDataFrame(part, "run long, account string, at long"), n, "q")
    log.append(spark.createDataFrame(rows[:20], "run long, account string, at long"), 0, "q")  # added already
    want = []
    for k in {r[1] for r in rows}:
        want += sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))[-6:]
    ordered = lambda x: sorted(map(tuple, x), key=lambda r: r[0])
    assert ordered(log.table().collect()) == ordered(want)
    before = log._state()[1]["files"]
    read, gone = log.doubtful(before)
    assert gone and len(read) + len(gone) < len(before)
    log.compact()
    after = log._state()[1]["files"]
    assert before[-1] in after and len(after) < len(before)
    assert ordered(log._read(after).collect()) == ordered(want)
    log.compact()
    assert log._state()[1]["files"] == after
    assert sorted(p.name for p in (tmp_path / "log" / "rows").iterdir()) == after


def test_write_path_in_cuts_is_the_batch(one_store, tmp_path):
    spark, rng = one_store, random.Random(12)
    rows, seqs = [], {}
    for e in range(1, 91):
        pub = f"p{rng.randrange(4)}"
        seq = seqs[pub] = seqs.get(pub, 0) + 1
        lines = []
        for _ in range(rng.randrange(1, 4)):
            key = f"encode:{pub}:{rng.randrange(3)}"
            lines.append(rng.choice([
                f"[[ENCODER-STAGE key={key} status={rng.choice(['queued', 'starting', 'running', 'running', 'done', 'failed'])} percent={rng.randrange(100)}.0]]", f"[[ENCODER-HOST key={key} instance=i{e} version={rng.choice(['', 'v1', 'v2'])}]]",
                f"[[ENCODER-TIMING key={key} cpu_s={e} total_s={2 * e} mem_mib=7]]", f"[[ENCODER-REUSED key={key}]]", f"[[ENCODER-FLEET machine={pub} busy={rng.randrange(9)} perf=8 chunks=c{e}]]", "no marker",
            ]))
        sent = 1000 + 2 * e
        late = rng.choice([0, 1, 2, 40])
        rows.append((pub, e, seq, sent, sent + late, "\n".join(lines)))
        if rng.random() < 0.2:
            old = rng.choice([r for r in rows if r[0] == pub])
            rows.append((pub, 1000 + e, old[2], old[3], sent + late, old[5]))
    rows.sort(key=lambda r: (r[4], r[1]))
    df = spark.createDataFrame([(*r, i // 40) for i, r in enumerate(rows)], path.MESSAGE + ", batch int")
    p = path.WritePath(spark, str(tmp_path / "in"), str(tmp_path / "out"), files_a_batch=1)
    for n in range(df.agg(F.max("batch")).first()[0] + 1):
        feed(spark, tmp_path, df, n)
        p.run()
    marks = path.accepted(df.drop("batch"))
    streamed = spark.read.schema(path.ACCEPTED).parquet(str(tmp_path / "out" / "accepted"))
    every = lambda d: sorted(map(str, d.select(*streamed.columns).collect()))
    assert every(streamed) == every(marks) and marks.count() < df.count() * 3
    fold = stages.stage_state_fold(path.transitions(marks)).where("accepted")
    want = fold.groupBy("key").agg(F.max_by(F.struct("status", "percent"), "seq").alias("r")).select("key", "r.*").collect()
    assert sorted(map(tuple, p.states.table().select("key", "status", "percent").collect())) == sorted(map(tuple, want))
    want = stages.stage_materialize(path.stage_events(marks))
    assert sorted(map(str, p.stages.table().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    now = path.gauges(marks).agg(F.max("ts")).first()[0]
    want = fleet.fleet_view(path.gauges(marks), now)
    cols = ["machine", "used_pct", "samples", "history", "chunks", "first_seen"]
    assert sorted(map(str, p.fleet.table().select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


@pytest.mark.parametrize("rows_a_block", [7, 1000])
def test_spend_and_history_in_blocks(spark, rows_a_block):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randrange(3000) * 7, i, rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "fleet long, ts long, seq long, rate double")
    got = {r.fleet: r for r in fleet.spend_integral(df, 21_000, 21_000, rows_a_block=rows_a_block).collect()}
    hist = fleet.downsample_history(df.withColumn("busy", F.col("rate")).withColumn("perf", F.lit(2.0)), 21_000, 21_000, 30, rows_a_block).collect()
    for f in (1, 2):
        own = sorted((ts, seq, r) for fl, ts, seq, r in rows if fl == f)
        want = sum((a[2] + b[2]) / 2 * (b[0] - a[0]) / 3600 for a, b in zip(own, own[1:]) if 0 < b[0] - a[0] <= 3600)
        assert got[f].spent == pytest.approx(want, abs=1e-4) and got[f].samples == len(own)
        stride = len(own) // 30 + 1 if len(own) > 30 else 1
        assert sorted(r.seq for r in hist if r.fleet == f) == sorted(seq for _, seq, _ in own[::stride])
