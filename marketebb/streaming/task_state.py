"""Stateful streams over task events and run logs.

Each keeps one small record per key and reads its rows in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketebb.functions import times
from marketebb.operators.tasks import BLOCK_STREAK, MAX_RETRIES, STREAK_TTL_S
from marketebb.streaming import with_rocksdb


class _OneRecord(StatefulProcessor):
    """Common part: one value state of the class's schema."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("record", self.schema)

    def kept(self):
        return self.state.get() if self.state.exists() else None

    def close(self) -> None:
        pass


def _stamped(df: DataFrame) -> DataFrame:
    """No watermark: rows of any age reach the state."""
    return with_rocksdb(df).withColumn("t", times.micros(F.col("ts"))).drop("ts")


def _timed(df: DataFrame, lateness: str) -> DataFrame:
    stamp = F.col("ts").cast("timestamp")
    return (
        with_rocksdb(df)
        .withColumn("event_time", stamp)
        .withWatermark("event_time", lateness)
        .withColumn("t", times.micros(F.col("ts")))
        .withColumn("ms", F.unix_millis("event_time"))
        .drop("ts")
    )


class PushGate(_OneRecord):
    """One open task per entity: pushes while it is open are refused."""

    schema = "open boolean, t long, seq long"
    out = Row("task_id", "ip_id", "t", "seq", "accepted", "late")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        is_open, *last = self.kept() or (False, None, None)
        for r in sorted(rows, key=lambda row: (row.t, row.seq)):
            if last[0] is not None and (r.t, r.seq) < tuple(last):
                if r.event == "pushed":
                    yield self.out(r.task_id, r.ip_id, r.t, r.seq, None, True)
                continue
            last = [r.t, r.seq]
            if r.event == "pushed":
                yield self.out(r.task_id, r.ip_id, r.t, r.seq, not is_open, False)
            is_open = r.event == "pushed"
        self.state.update((is_open, *last))


def push_gate(events: DataFrame) -> DataFrame:
    """Pushes with the verdict of the one-open-task rule, as they come in.

    ``late`` pushes are older than what the gate has already judged; they come out without a verdict and change nothing.
    """
    relevant = _stamped(events.filter(F.col("event").isin("pushed", "acked", "dead")))
    judged = (
        relevant.select("ip_id", "task_id", "event", "t", "seq")
        .groupBy("ip_id")
        .transformWithState(
            PushGate(), "task_id string, ip_id long, t long, seq long, accepted boolean, late boolean", "Append", "None"
        )
    )
    return judged.withColumn("ts", times.from_micros(F.col("t"))).drop("t")


class StuckTask(_OneRecord):
    """A timer per started task; it fires unless the task ends first."""

    schema = "ip_id long, retry_count int, timer long"
    out = Row("task_id", "ip_id", "retry_count", "outcome")

    def __init__(self, timeout_s: int, max_retries: int):
        self.timeout_ms, self.max_retries = timeout_s * 1000, max_retries

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        record = self.kept()
        timer = record[2] if record else None
        wanted, ip_id, retries = timer, record[0] if record else None, record[1] if record else 0
        for r in sorted(rows, key=lambda row: (row.t, row.seq)):
            ip_id, retries = r.ip_id, r.retry_count
            wanted = r.ms + self.timeout_ms + 1 if r.event == "started" else None
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is None:
            self.state.clear()
        else:
            if timer != wanted:
                self.handle.registerTimer(wanted)
            self.state.update((ip_id, retries, wanted))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ip_id, retries, _ = self.state.get()
        self.state.clear()
        outcome = "dead" if retries + 1 > self.max_retries else "retry"
        return iter((self.out(key[0], ip_id, retries + 1, outcome),))


def stuck_task_stream(
    events: DataFrame, timeout_s: int = 1800, max_retries: int = MAX_RETRIES, lateness: str = "2 hours"
) -> DataFrame:
    """Tasks that started and did not end within the timeout, as event time passes it."""
    return (
        _timed(events, lateness)
        .select("task_id", "ip_id", "event", "retry_count", "t", "ms", "seq", "event_time")
        .groupBy("task_id")
        .transformWithState(
            StuckTask(timeout_s, max_retries),
            "task_id string, ip_id long, retry_count int, outcome string",
            "Append",
            "EventTime",
        )
    )


class BlockStreak(_OneRecord):
    """Blocks since the last success or the last long pause."""

    schema = "streak long, t long"
    out = Row("node", "task_id", "t", "streak", "cooldown", "late")

    def __init__(self, threshold: int, ttl_s: int):
        self.threshold, self.ttl_us = threshold, ttl_s * times.US_PER_SECOND

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        streak, last = self.kept() or (0, None)
        for r in sorted(rows, key=lambda row: (row.t, row.task_id)):
            if last is not None and r.t < last:
                if r.outcome == "403_forbidden":
                    yield self.out(key[0], r.task_id, r.t, None, None, True)
                continue
            if r.outcome != "403_forbidden" or (last is not None and r.t - last > self.ttl_us):
                streak = 0
            last = r.t
            if r.outcome == "403_forbidden":
                streak += 1
                yield self.out(key[0], r.task_id, r.t, streak, streak == self.threshold, False)
        self.state.update((streak, last))


def block_streak_stream(
    log: DataFrame, threshold: int = BLOCK_STREAK, ttl_s: int = STREAK_TTL_S
) -> DataFrame:
    """Blocked runs with the node's streak; ``cooldown`` marks the one that reaches the threshold.

    ``late`` runs are older than what the streak already counts; they come out without a streak and change nothing.
    """
    relevant = log.filter(F.col("outcome").isin("success", "empty_result", "403_forbidden"))
    counted = (
        _stamped(relevant)
        .select("node", "task_id", "outcome", "t")
        .groupBy("node")
        .transformWithState(
            BlockStreak(threshold, ttl_s),
            "node string, task_id long, t long, streak long, cooldown boolean, late boolean",
            "Append",
            "None",
        )
    )
    return counted.withColumn("ts", times.from_micros(F.col("t"))).drop("t")
