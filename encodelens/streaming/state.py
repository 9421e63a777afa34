"""Batch forms of the stream operators: replay guard, lateness, heartbeat packets, delivery lag. Streams are in stateful.py, tables they keep in store.py."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from encodelens.operators.blocks import ROWS_A_BLOCK, fold_in_blocks

# Seconds after which a gauge is stale, heartbeats a packet holds at most, seconds that the first of them waits.
MAX_GAUGE_AGE_S, BATCH, FLUSH_S = 30, 10, 3


def replay_guard(events: DataFrame) -> DataFrame:
    """Events without replays: a seq at or below the highest seen of its publisher is one; records pass all the same.

    A seq of 0 or null is never a replay. events: (publisher, seq, arrival, marker_class).
    """
    return replays(events).where(~F.col("replay") | (F.col("marker_class") == "record"))


def replays(messages: DataFrame) -> DataFrame:
    """messages (publisher, event, seq, arrival, ...) with `replay`: whether the publisher's seq was seen before."""
    seen = F.max("seq").over(W.partitionBy("publisher").orderBy("arrival", "event").rowsBetween(W.unboundedPreceding, -1))
    replay = (F.coalesce("seq", F.lit(0)) > 0) & (F.col("seq") <= F.coalesce("_seen", F.lit(0)))
    return messages.withColumn("_seen", seen).withColumn("replay", replay).drop("_seen")


def late_gauge_drop(events: DataFrame, most_s: int = MAX_GAUGE_AGE_S) -> DataFrame:
    """Events without gauges that were over most_s seconds old when they arrived; records and live events are never late."""
    return events.where((F.col("marker_class") != "gauge") | (F.col("arrival") - F.col("sent") <= most_s))


def event_lag(events: DataFrame) -> DataFrame:
    """Per status: events, mean and greatest delivery time, from stop, start or sending, whichever is there first."""
    lag = F.col("arrival") - F.coalesce("stopped", "started", "sent")
    return events.withColumn("lag_s", lag).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lag_s"), 4).alias("mean_s"), F.max("lag_s").alias("most_s"), F.count_if(F.col("suppressed")).alias("suppressed"))


def heartbeat_compaction(events: DataFrame, most: int = BATCH, flush_s: int = FLUSH_S, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(publisher, n, first_seq, last_seq): a publisher's events in packets, by seq.

    An event that is no heartbeat goes out at once with the heartbeats that wait; heartbeats alone go when there are
    `most`, or flush_s seconds after the first of them was sent. Where a packet ends depends on where the one before it
    ended; a block of seq tells for each of its first `most` rows what waits at its end if a packet begins there.
    """

    def step(waiting: tuple | None, row: tuple) -> tuple:
        key, seq, sent, beat = row
        given = None
        if waiting and sent - waiting[3] >= flush_s:
            given, waiting = waiting, None
        waiting = (waiting[0] + 1, waiting[1], seq, waiting[3], key) if waiting else (1, seq, seq, sent, key)
        if waiting[0] == most or not beat:
            given, waiting = [g for g in (given, waiting) if g], None  # a flush by time and one by the row itself
        return waiting, given

    def effect(rows: Iterator[tuple]) -> tuple:
        rows = list(rows)
        ends: dict[int, tuple | None] = {}
        at: dict[int, list[int]] = {i: [i] for i in range(min(most, len(rows)))}
        while at:  # packets from the earliest start on; starts that meet go on as one
            i = min(at)
            of, n, start = at.pop(i), 0, rows[i][2]
            j = i
            while j < len(rows) and rows[j][2] - start < flush_s and n < most:
                n, j = n + 1, j + 1
                if not rows[j - 1][3]:
                    break
            closed = n == most or not rows[j - 1][3]
            if j < len(rows):
                at.setdefault(j, []).extend(of)
            else:
                ends.update(dict.fromkeys(of, None if closed else (n, rows[i][1], rows[-1][1], start, rows[i][0])))
        return [r[1:] for r in rows[:most]], len(rows), ends

    def through(waiting: tuple | None, what: tuple) -> tuple | None:
        head, n, ends = what
        at = 0
        if waiting:
            count, first, last, start, key = waiting
            for i, (seq, sent, beat) in enumerate(head):
                if sent - start >= flush_s:
                    at = i
                    break
                count, last = count + 1, seq
                if count == most or not beat:
                    at = i + 1
                    break
            else:
                return count, first, last, start, key
        return ends[at] if at < n else None

    def packets(waiting: tuple | None, row: tuple) -> tuple:
        waiting, given = step(waiting, row)
        given = given if isinstance(given, list) else [given] if given else []
        return waiting, ([(g[0], g[1], g[2]) for g in given], row[0]) if given else None

    rows = events.select("publisher", F.col("seq").cast("long").alias("seq"), F.col("sent").cast("long").alias("sent"), F.col("is_heartbeat").alias("beat"))
    kind = rows.schema["publisher"].dataType.simpleString()
    out = fold_in_blocks(
        rows, "publisher", ["seq", "sent"], f"p array<struct<n long, first_seq long, last_seq long>>, publisher {kind}", None, packets, effect, through,
        lambda w: ([(w[0], w[1], w[2])], w[4]) if w else None, rows_a_block,
    )
    return out.select("publisher", F.inline("p"))
