"""Steps that must not hold more, or do more, as tables grow: what is looked at is the plan or what a task is given."""

import bisect

from pyspark.sql import functions as F

from encodelens.functions import scalars as S
from encodelens.operators import cost, curves, fleet, ladders, series, stages
from encodelens.operators.blocks import block_of, fold_in_blocks
from encodelens.plans import views
from encodelens.sources import files


def nodes(df):
    """The nodes of a DataFrame's optimized plan."""

    def walk(p):
        yield p
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))

    return list(walk(df._jdf.queryExecution().optimizedPlan()))


def names(node):
    return {node.output().apply(i).name() for i in range(node.output().size())}


def test_rental_totals_windows_hold_seconds_alone(spark):
    """Spans that end in the same few seconds do not meet in the window of a block."""
    jobs = spark.range(400).select(F.col("id").alias("exec"), (F.col("id") % 3).alias("instance"), F.lit(5000).cast("long").alias("start_s"), F.when(F.col("id") % 7 > 0, 6000 + F.col("id") % 2).alias("stop_s"), F.lit(2).alias("vcpu"))
    boxes = spark.range(40).select(F.col("id").alias("instance"), F.lit(4).alias("vcpu"), (4000 + F.col("id") * 100).alias("launch"), F.when(F.col("id") % 2 == 0, 9000 + F.col("id")).alias("ended"))
    got = cost.rental_totals(jobs, boxes, 10_000)
    assert not any("exec" in names(w) for w in nodes(got) if w.nodeName() == "Window")
    pairs = cost.machine_rental(jobs, boxes, 10_000).groupBy("exec").agg(F.count(F.lit(1)), F.count_if(F.col("jobs") == 0), F.sum("rented_vcpu_s"), F.sum("allocated_vcpu_s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and got.count() == 400


def test_folds_sum_up_large_keys_alone(spark):
    """Many keys of few rows are folded in one pass; only a key of several blocks has effects."""
    rows = spark.range(600).select(F.when(F.col("id") < 300, F.lit(7)).when(F.col("id") < 310, F.lit(None)).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("at"))

    def effect(block):
        block = list(block)
        assert {r[0] for r in block} == {7}  # rows of another key would fail the task
        return len(block)

    def fold(rows_a_block):
        out = fold_in_blocks(rows, "key", ["at"], "key long, n long", 0, lambda n, r: (n + 1, (r[0], n + 1)), effect, lambda n, m: n + m, lambda n: (-1, n), rows_a_block=rows_a_block)
        return sorted(((r.key if r.key is not None else -2), r.n) for r in out.collect())

    want = sorted([(7, i) for i in range(1, 301)] + [(-2, i) for i in range(1, 11)] + [(k, 1) for k in range(310, 600)] + [(-1, 300), (-1, 10)] + [(-1, 1)] * 290)
    assert fold(40) == want and fold(1000) == want


def test_blocks_are_found_by_halving(spark):
    """A row meets about the logarithm of the bounds, not each of them."""
    for bounds in ([5], [0, 5], [-3, 0, 2, 2, 9, 11, 40]):
        df = spark.createDataFrame([(x,) for x in (None, *range(-5, 45))], "x long").select("x", block_of("x", bounds).alias("b"))
        assert all(r.b == (0 if r.x is None else bisect.bisect_right(bounds, r.x)) for r in df.collect())
    met = spark.range(1).select(block_of("id", list(range(1000))).alias("b"))
    assert "512" in met._jdf.queryExecution().analyzed().toString().split("aggregate(")[1]


def test_speed_ewma_is_dealt_by_rows(spark):
    """Samples are dealt in as many parts as blocks, whatever their bytes."""
    s = spark.range(1000).select(F.lit("m").alias("machine"), F.lit("av1").alias("codec"), F.lit(360).alias("height"), F.col("id").alias("seq"), (1 + F.col("id") % 7).cast("double").alias("speed"))
    got = fleet.speed_ewma(s, rows_a_block=100)
    assert [n.numPartitions() for n in nodes(got) if n.nodeName() == "RepartitionByExpression"] == [10]
    assert got.collect() == fleet.speed_ewma(s).collect()


def test_stages_are_dealt_in_bounded_parts(spark, data, monkeypatch):
    """What is joined and grouped by job lies in parts of bounded rows, and is what it was."""
    whole = views.Views(spark, data).stages
    monkeypatch.setattr(views, "MOST_UNDEALT", 100, raising=False)
    monkeypatch.setattr(views, "ROWS_A_BLOCK", 1000, raising=False)
    parts = views.Views(spark, data).stages
    n = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 1000)
    assert [x.numPartitions() for x in nodes(parts) if x.nodeName() == "RepartitionByExpression"] == [n, n]
    assert parts.exceptAll(whole).isEmpty() and whole.exceptAll(parts).isEmpty()


def test_run_records_by_one_join(spark):
    """Stages and folders meet once, and a record tells its cost without a join."""
    st = spark.createDataFrame([(1, "a", "encode:av1:360p:chunk0", "done", 5, 9, 2.0, 2), (1, "a", "package:1", "done", 9, 12, 1.0, 3), (1, "b", "encode:av1:360p:chunk1", "done", 6, 8, 4.0, 1), (2, "a", "encode:hevc:720p", "done", 1, 3, 0.0, 7)], "job long, file string, key string, status string, started long, ended long, cpu_s double, seq long")
    out = spark.createDataFrame([(1, "d1", "av1", "a"), (1, "d2", "av1", "b"), (2, "d3", "hevc", "a")], "job long, dir string, codec string, source string")
    r = files.run_records(st, out)
    assert sum(n.nodeName() == "Join" for n in nodes(r)) == 1
    r = files.with_costs(r, F.struct(F.lit(0.0).alias("spot"), F.lit(0.0).alias("egress"), F.aggregate("stages", F.lit(0.0), lambda n, x: n + x["cpu_s"]).alias("total")))
    got = {x.dir: ([s.seq for s in x.stages], [(p.phase, p.n, p.span_s) for p in x.phases], x.rungs, x.cost and x.cost.total) for x in r.collect()}
    assert got == {"d1": ([2, 3], [("encode:av1:360p", 1, 4), ("package:1", 1, 3)], ["360p"], 3.0), "d2": ([1], [("encode:av1:360p", 1, 2)], ["360p"], 4.0), "d3": ([7], [("encode:hevc:720p", 1, 2)], ["720p"], None)}


def test_fundamental_period_joins_nothing(spark):
    """A series' correlations are read once."""
    waves = spark.createDataFrame([(s, lag, float(lag % s == 0) - 0.01 * lag) for s in (4, 5) for lag in range(25)] + [(9, lag, 0.0) for lag in range(25)], "series long, lag int, r double")
    got = series.fundamental_period(waves)
    assert not any(n.nodeName() == "Join" for n in nodes(got))
    assert {r.series: r.period for r in got.collect()} == {4: 4, 5: 5, 9: None}


def test_outputs_of_a_ladder_are_sliced(spark):
    """Outputs that share a ladder are not one task's."""
    o = spark.range(400).select(F.col("id").alias("output"), F.when(F.col("id") % 50 > 0, "p").alias("profile"), F.lit("av1").alias("codec"), F.lit("s").alias("source"), F.lit(1).alias("source_size"), F.lit(2).alias("source_modified"))
    r = spark.createDataFrame([("p", "av1", 2, 720, 900, None), ("p", "av1", 1, 360, 400, 50.0)], "ladder string, codec string, pos long, height int, kbps int, vmaf double")
    got = curves.encode_meta(o, r, outputs_a_task=20)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(x.output for x in rows) == list(range(400)) and len({x.task for x in rows}) > 10
    assert all((x.rungs, x.scored, x.vmaf_state) == (("360@400=50.0000 720@900=none", 1, "partial") if x.profile else (None, 0, "none")) for x in rows)


def test_argv_is_read_once_a_row(spark):
    """The words of a command line are bound once, not built anew for each word and its neighbours."""
    plan = spark.range(1).select(S.normalize_argv(F.array(F.lit("-i"), F.concat(F.lit("word"), F.col("id")))).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(word") == 1


def test_active_time_leaves_no_tie_open(spark):
    """No second window numbers what a first has sorted, so equal intervals count once in any order."""
    rows = [(1, 0, 5, 9), (1, 0, 20, 30), (1, 0, 20, 30), (1, 0, 20, 25), (1, 0, 30, 31), (2, 0, 7, 8), (2, 0, 7, 8), (2, 0, 7, None), (2, 0, 7, None), (2, 0, None, 50), (3, 4, None, None), (3, 4, 12, 11), (3, 4, 12, 11), (4, 4, None, None)]
    want = {1: (5, 15, 26, 11), 2: (7, 93, 93, 0), 3: (8, 0, 0, 0), 4: (96, 0, 0, 0)}
    for some in (rows, rows[::-1]):
        got = stages.active_time(spark.createDataFrame(some, "job long, submitted long, started long, ended long"), 100)
        assert sum(n.nodeName() == "Window" for n in nodes(got)) == 1
        assert {r.job: (r.queued_s, r.active_s, r.span_s, r.idle_s) for r in got.collect()} == want


def runs(rows, at):
    """How often a value differs from that of the row before."""
    return sum(a[at] != b[at] for a, b in zip(rows, rows[1:]))


def test_pairs_are_made_set_by_set(spark, monkeypatch):
    """Requests meet a rung as a set, so a written table of pairs repeats itself, and as many tasks as rungs ask for."""
    rungs = spark.range(400).selectExpr("'L' as ladder", "'h264' as codec", "id as pos", "if(id % 4 = 0, 1920, 640) as width", "360 as height", "1 as kbps")
    q = spark.createDataFrame([(i if i else None, "L", (640, 1920, None, 0)[i % 4], 24 + i % 2) for i in range(40)], "request long, ladder string, src_width int, fps int")
    want = sorted((i, p, 24 + i % 2 + p) for i in range(40) for p in range(400) if i % 4 or p % 4)
    monkeypatch.setattr(ladders, "RUNGS_A_TASK", 40, raising=False)
    for df in (ladders.resolve_rungs(rungs, q), ladders.all_pairs(rungs, q, same=("ladder", "src_width", "fps"), once={"sum": F.col("fps") + F.col("pos")})):
        rows = df.collect()
        assert sorted((r.request or 0, r.pos, r.sum if "sum" in r else r.fps + r.pos) for r in rows) == want
        assert runs(rows, "pos") < len(rows) / 8
        assert [n.numPartitions() for n in nodes(df) if n.nodeName() == "RepartitionByExpression"] == [10, 10]
        assert "exists(_set" in next(n for n in nodes(df) if n.nodeName() == "Join").toString()  # else a set's pairs are held at once


def test_ranked_pairs_are_made_set_by_set(spark, monkeypatch):
    """Requests that rank a rung alike meet it together."""
    rungs = spark.range(300).selectExpr("'L' as ladder", "if(id % 2 = 0, 'h264', 'hevc') as codec", "id as pos", "640 as width", "360 as height", "1 as kbps")
    q = spark.range(50).selectExpr("id as request", "'L' as ladder", "640 as src_width", "cast(60 + id as double) as duration")
    groups = ladders.for_requests(ladders.rung_groups(rungs), q).withColumn("speed", F.when(F.col("codec") == "h264", 2.0).otherwise(0.5))
    monkeypatch.setattr(ladders, "RUNGS_A_TASK", 50, raising=False)
    got = ladders.predicted_wall_rank(groups, rungs)
    rows = got.collect()
    want = [(i, n, p, (60.0 + i) / (0.5 if p % 2 else 2.0)) for i in range(50) for n, p in enumerate([*range(1, 300, 2), *range(0, 300, 2)], 1)]
    assert sorted((r.request, r["rank"], r.pos, r.wall_s) for r in rows) == want
    assert runs(rows, "pos") < len(rows) / 20
    assert 6 in [n.numPartitions() for n in nodes(got) if n.nodeName() == "RepartitionByExpression"]


def test_copies_of_a_ladders_text_leave_one_by_one(spark):
    """A compiled loop would hold a ladder's text once for each slice of its outputs."""
    o = spark.range(400).select(F.col("id").alias("output"), F.lit("p").alias("profile"), F.lit("av1").alias("codec"), F.lit("s").alias("source"), F.lit(1).alias("source_size"), F.lit(2).alias("source_modified"))
    r = spark.createDataFrame([("p", "av1", 1, 360, 400, 50.0)], "ladder string, codec string, pos long, height int, kbps int, vmaf double")
    got = curves.encode_meta(o, r, outputs_a_task=20)
    listed = [n.toString() for n in nodes(got) if n.nodeName() == "Generate"]
    assert len(listed) == 1 and "lambdafunction" in listed[0]
    assert got.where("rungs = '360@400=50.0000'").count() == 400
