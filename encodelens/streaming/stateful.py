"""Stateful streams, each with a batch form that gives the same rows: transformWithState with values, lists, timers and TTL.

They need the RocksDB state store, see CONF. Events of a key come in seq order over micro-batches, as transport keeps the
order of a publisher; within a micro-batch they are sorted here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from encodelens.operators.fleet import GAP_S, RING, TTL_S
from encodelens.operators.stages import after

#: What a session needs for these streams.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HOUR_MS, DAY_S = 3_600_000, 86_400


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _tuples(df: pd.DataFrame, cols: list[str]) -> Iterator[tuple]:
    """Rows as tuples in which a missing value is None."""
    return zip(*(df[c].astype(object).where(df[c].notna(), None) for c in cols))


class _ReplayGuard(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "seq long", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        top = self.top.get()[0] if self.top.exists() else 0
        b = _in_order(rows, ["arrival", "event"])
        seq = b["seq"].fillna(0).astype("int64")
        b["replay"] = (seq > 0) & (seq <= seq.cummax().shift(1, fill_value=0).clip(lower=top))
        self.top.update((int(max(top, seq.max())),))
        yield b

    def close(self) -> None:
        pass


def replays_stream(messages: DataFrame, idle_ms: int = HOUR_MS) -> DataFrame:
    """messages (publisher, event, seq, arrival, ...) with `replay`: whether the publisher's seq was seen before.

    The state of a publisher is its highest seq, forgotten idle_ms after its last message.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema) + ", replay boolean"
    return messages.groupBy("publisher").transformWithStateInPandas(_ReplayGuard(idle_ms), schema, "Append", "ProcessingTime")


def replay_guard_stream(events: DataFrame, idle_ms: int = HOUR_MS) -> DataFrame:
    """replay_guard on a stream: replays go, but for records. All columns pass."""
    return replays_stream(events, idle_ms).where(~F.col("replay") | (F.col("marker_class") == "record"))


class _StageFold(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, percent double", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, out = (tuple(self.state.get()) if self.state.exists() else (None, 0.0)), []
        b = _in_order(rows, ["seq"])
        for seq, status, percent, src in _tuples(b, ["seq", "status", "percent", "src"]):
            accepted, state = after(state, status, percent)
            out.append((key[0], seq, src, accepted, *state))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["key", "seq", "src", "accepted", "status", "percent"])

    def close(self) -> None:
        pass


def stage_fold_stream(events: DataFrame, idle_ms: int = DAY_S * 1000) -> DataFrame:
    """stage_state_fold on a stream (without the width): a key's status and percent, forgotten idle_ms after its last event."""
    schema = "key string, seq long, src string, accepted boolean, status string, percent double"
    rows = events.select("key", F.col("seq").cast("long"), "status", F.col("percent").cast("double"), "src")
    return rows.groupBy("key").transformWithStateInPandas(_StageFold(idle_ms), schema, "Append", "ProcessingTime")


class _Speed(StatefulProcessor):
    def __init__(self, weight: float):
        self.weight = weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "speed double, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        speed, n = self.state.get() if self.state.exists() else (0.0, 0)
        x = _in_order(rows, ["seq", "speed"])["speed"]
        x = x[x > 0].to_numpy()
        if not len(x):
            return
        if not n:
            speed, n, x = float(x[0]), 1, x[1:]
        left = (1 - self.weight) ** (len(x) - 1 - pd.RangeIndex(len(x)).to_numpy())
        speed, n = float(speed * (1 - self.weight) ** len(x) + self.weight * (x * left).sum()), n + len(x)
        self.state.update((speed, n))
        yield pd.DataFrame([(*key, speed, n)], columns=["machine", "codec", "height", "speed", "n"])

    def close(self) -> None:
        pass


def speed_ewma_stream(samples: DataFrame, weight: float = 0.3) -> DataFrame:
    """speed_ewma on a stream, in update mode: the state of a key is its speed and samples, a batch is one affine map."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("machine", "codec", "height")) + ", speed double, n long"
    rows = samples.select("machine", "codec", "height", "seq", F.col("speed").cast("double").alias("speed"))
    return rows.groupBy("machine", "codec", "height").transformWithStateInPandas(_Speed(weight), schema, "Update", "None")


class _FleetPanel(StatefulProcessor):
    def __init__(self, gap_s: int, ring: int, ttl_s: int, keep_s: int):
        self.gap_s, self.ring, self.ttl_s, self.keep_s = gap_s, ring, ttl_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getListState("uses", "ts long, used double")
        self.known = handle.getMapState("known", "field string", "value string")
        self.ends = handle.getValueState("ends", "first_seen long, last long, asked long")

    def _row(self, key: Any, gone: bool) -> pd.DataFrame:
        uses, known = list(self.uses.get()), {k[0]: v[0] for k, v in self.known.iterator()}
        first, last, asked = self.ends.get()
        used = [round(u, 4) for _, u in uses]
        row = (key[0], last, used[-1], round(sum(u for _, u in uses) / len(uses), 4), len(uses), used, known.get("chunks"), known.get("version"), first, asked, gone)
        return pd.DataFrame([row], columns=["machine", "ts", "used_pct", "mean_pct", "samples", "history", "chunks", "version", "first_seen", "asked", "gone"])

    def _timers(self, last: int | None, add: bool) -> None:
        for s in (self.ttl_s, self.keep_s):
            if last is not None:
                at = (last + s) * 1000 + 1
                self.handle.registerTimer(at) if add else self.handle.deleteTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, before, asked = self.ends.get() if self.ends.exists() else (None, None, 0)
        b, last, fresh = _in_order(rows, ["ts", "seq"]), before, []
        for ts, busy, perf, version, chunks in _tuples(b, ["ts", "busy", "perf", "version", "chunks"]):
            first = ts if first is None else min(first, ts)
            if version:
                self.known.updateValue(("version",), (version,))
            self.known.updateValue(("chunks",), (chunks,))
            if last is None or ts - last >= self.gap_s:
                last = ts
                fresh.append((int(ts), 100 * busy / perf if perf and perf > 0 else 0.0))
        if fresh:
            self.uses.put((list(self.uses.get()) + fresh)[-self.ring :] if self.uses.exists() else fresh[-self.ring :])
        self.ends.update((int(first), int(last), asked + len(b)))
        if last != before:
            self._timers(before, False)
            self._timers(last, True)
        yield self._row(key, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.ends.exists():
            return
        last = self.ends.get()[1]
        if expiredTimerInfo.getExpiryTimeInMs() > (last + self.keep_s) * 1000:
            for s in (self.uses, self.known, self.ends):
                s.clear()
            return
        yield self._row(key, True)

    def close(self) -> None:
        pass


def fleet_panel_stream(samples: DataFrame, gap_s: int = GAP_S, ring: int = RING, ttl_s: int = TTL_S, keep_s: int = DAY_S) -> DataFrame:
    """fleet_view on a stream, in update mode: a machine's row whenever a sample of it comes, and a row with `gone` once it
    has been silent for ttl_s of event time.

    The ring of uses is a list, version and chunks a map, `asked` counts the samples seen; a sample within gap_s of the last counted one still renews
    chunks and version. A silent machine comes back with its old uses and first sight, until keep_s, when its state is
    cleared. Put the rows into a KeyedStore by machine with gone="gone". samples: (machine, ts in seconds, seq, busy,
    perf, version, chunks).
    """
    kind = samples.schema["machine"].dataType.simpleString()
    schema = f"machine {kind}, ts long, used_pct double, mean_pct double, samples long, history array<double>, chunks string, version string, first_seen long, asked long, gone boolean"
    rows = samples.select("machine", F.col("ts").cast("long").alias("ts"), "seq", F.col("busy").cast("double"), F.col("perf").cast("double"), "version", "chunks", F.timestamp_seconds("ts").alias("at"))
    return rows.withWatermark("at", "0 seconds").groupBy("machine").transformWithStateInPandas(_FleetPanel(gap_s, ring, ttl_s, keep_s), schema, "Update", "EventTime")


class _Heartbeats(StatefulProcessor):
    def __init__(self, most: int, flush_s: int):
        self.most, self.flush_s = most, flush_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, sent long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        timer, out = held[0][1] if held else None, []
        b = _in_order(rows, ["seq"])
        for seq, sent, beat in zip(b["seq"].tolist(), b["sent"].tolist(), b["is_heartbeat"].tolist()):
            if held and sent - held[0][1] >= self.flush_s:
                out.append(held)
                held = []
            held.append((seq, sent))
            if len(held) == self.most or not beat:
                out.append(held)
                held = []
        start = held[0][1] if held else None
        if start != timer:
            if timer is not None:
                self.handle.deleteTimer((timer + self.flush_s) * 1000)
            if start is not None:
                self.handle.registerTimer((start + self.flush_s) * 1000)
        self.waiting.put(held) if held else self.waiting.clear()
        if out:
            yield self._packets(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        if held and (held[0][1] + self.flush_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.waiting.clear()
            yield self._packets(key, [held])

    @staticmethod
    def _packets(key: Any, packets: list[list[tuple]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], len(p), p[0][0], p[-1][0]) for p in packets], columns=["publisher", "n", "first_seq", "last_seq"])

    def close(self) -> None:
        pass


def heartbeat_stream(events: DataFrame, most: int = 10, flush_s: int = 3) -> DataFrame:
    """heartbeat_compaction on a stream: waiting heartbeats are a list, and a timer of event time sends them flush_s after the first.

    events: (publisher, seq, sent in seconds, is_heartbeat).
    """
    kind = events.schema["publisher"].dataType.simpleString()
    rows = events.select("publisher", F.col("seq").cast("long"), F.col("sent").cast("long"), "is_heartbeat", F.timestamp_seconds("sent").alias("at")).withWatermark("at", "0 seconds")
    return rows.groupBy("publisher").transformWithStateInPandas(_Heartbeats(most, flush_s), f"publisher {kind}, n long, first_seq long, last_seq long", "Append", "EventTime")
