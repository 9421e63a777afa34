"""The write path as streams: packed messages to accepted markers, and from those to the tables that pages read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from encodelens.operators import fleet, stages
from encodelens.sources import markers
from encodelens.streaming import state, stateful
from encodelens.streaming.store import KeyedStore

MESSAGE = "publisher string, event long, seq long, sent long, arrival long, body string"
ACCEPTED = (
    "publisher string, event long, seq long, place int, sent long, arrival long, kind string, marker_class string, is_heartbeat boolean, key string, status string, percent double, "
    "instance string, version string, cpu_s double, total_s double, mem_mib double, machine string, busy double, perf double, chunks string"
)
#: Markers of a message at most; (seq, place) as one number orders what a publisher says.
PLACES = 1 << 16


def accepted(messages: DataFrame, most_s: int = state.MAX_GAUGE_AGE_S) -> DataFrame:
    """Markers that count, of a stream or a table of packed messages (MESSAGE): a replayed message keeps its records only,
    and a gauge that is over most_s seconds old when it arrives goes."""
    seen = stateful.replays_stream(messages) if messages.isStreaming else state.replays(messages)
    m = markers.classify_marker(markers.parse_marker(markers.unpack_batches(seen))).where("kind is not null")
    m = state.late_gauge_drop(m.where(~F.col("replay") | (F.col("marker_class") == "record")), most_s)
    number = lambda c: markers.field(c, "double").alias(c)
    return m.select(
        "publisher", "event", "seq", "place", "sent", "arrival", "kind", "marker_class", "is_heartbeat", markers.field("key").alias("key"), markers.field("status").alias("status"), number("percent"),
        markers.field("instance").alias("instance"), markers.field("version").alias("version"), *map(number, ("cpu_s", "total_s", "mem_mib")), markers.field("machine").alias("machine"), number("busy"), number("perf"), markers.field("chunks").alias("chunks"),
    )


def _numbered(marks: DataFrame) -> DataFrame:
    return marks.withColumn("seq", F.coalesce("seq", F.lit(0)) * PLACES + F.col("place"))


def transitions(marks: DataFrame) -> DataFrame:
    return _numbered(marks.where("kind = 'STAGE' and key is not null")).select("key", "seq", "status", "percent", F.lit("worker").alias("src"))


def stage_events(marks: DataFrame) -> DataFrame:
    return _numbered(marks.where("kind in ('STAGE', 'HOST', 'TIMING', 'REUSED') and key is not null"))


def gauges(marks: DataFrame) -> DataFrame:
    return _numbered(marks.where("kind = 'FLEET' and machine is not null")).select("machine", F.col("sent").alias("ts"), "seq", "busy", "perf", "version", "chunks")


class WritePath:
    """Four streams over a folder of messages: accepted markers, and from them the stage states, stage rows and fleet panel.

    Accepted markers are files that the other three read, so that each has its own checkpoint and pace, and markers are
    judged once. State is in RocksDB. The watermark is on gauges alone: stages and records are never late.
    """

    def __init__(self, spark: SparkSession, source: str, root: str, files_a_batch: int = 1000, gap_s: int = fleet.GAP_S, ttl_s: int = fleet.TTL_S):
        self.spark, self.source, self.root, self.files_a_batch = spark, source, root.rstrip("/"), files_a_batch
        self.gap_s, self.ttl_s = gap_s, ttl_s
        self.states = KeyedStore(spark, f"{self.root}/states", ["key"], "seq")
        self.stages = KeyedStore(spark, f"{self.root}/stages", ["key"], "seen")
        self.fleet = KeyedStore(spark, f"{self.root}/fleet", ["machine"], "order", gone="gone")

    def _marks(self) -> DataFrame:
        return self.spark.readStream.schema(ACCEPTED).option("maxFilesPerTrigger", self.files_a_batch).parquet(f"{self.root}/accepted")

    def _start(self, df: DataFrame, name: str, mode: str, table: KeyedStore | None, once: bool, idle: bool = False) -> StreamingQuery:
        w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{self.root}/checkpoints/{name}").queryName(name)
        w = w.trigger(availableNow=True) if once else w.trigger(processingTime="3 seconds")
        w = w.foreachBatch(table.put) if table else w.format("parquet").option("path", f"{self.root}/accepted")
        # state that ends by the clock asks for batches without data, and a run that is to end would wait for them for ever
        conf, setting = self.spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(setting)
        conf.set(setting, str(idle or not once).lower())
        try:
            return w.start()
        finally:
            conf.set(setting, before)

    def accept(self, once: bool = True) -> StreamingQuery:
        messages = self.spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", self.files_a_batch).parquet(self.source)
        return self._start(accepted(messages), "accepted", "append", None, once)

    def fold(self, once: bool = True) -> StreamingQuery:
        kept = stateful.stage_fold_stream(transitions(self._marks())).where("accepted").select("key", "seq", "status", "percent")
        return self._start(kept, "states", "append", self.states, once)

    def materialize(self, once: bool = True) -> StreamingQuery:
        rows = stages.stage_rows(stages.registers(stage_events(self._marks())), "seen")
        return self._start(rows, "stages", "update", self.stages, once)

    def panel(self, once: bool = True) -> StreamingQuery:
        rows = stateful.fleet_panel_stream(gauges(self._marks()), self.gap_s, ttl_s=self.ttl_s)
        # a machine's later row has a later count or sample; that it is gone comes after its last sample
        order = F.struct("ts", F.col("gone").cast("int").alias("gone"), F.col("asked").alias("asked"))
        return self._start(rows.withColumn("order", order), "fleet", "update", self.fleet, once, idle=True)

    def run(self) -> None:
        """All that is there, once: restarts go on where the checkpoints are, in any number of cuts."""
        for start in (self.accept, self.fold, self.materialize, self.panel):
            start().awaitTermination()
