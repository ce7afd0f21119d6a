"""The same rules on streams: polling, throttling, state machines, windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyquarry.operators.lifecycle import pending


def due_tasks(changes: DataFrame) -> DataFrame:
    """Stateless: the task rows of a stream that are due."""
    return changes.where(pending())


def throttle(events: DataFrame, seconds: float) -> DataFrame:
    """(task_id, ts) at least so long after the task's last one let through; the state is one number a task, dropped after an hour without events."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(t for b in batches for t in b["us"].tolist()):
            if last is None or at - last >= seconds * 1e6:
                last = at
                out.append(at)
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"task_id": [key[0]] * len(out), "us": out})

    rows = events.select("task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).groupBy("task_id")
    out = rows.applyInPandasWithState(step, "task_id bigint, us bigint", "last bigint", "append", "ProcessingTimeTimeout")
    return out.select("task_id", F.timestamp_micros("us").alias("ts"))


#: What an event makes of a status: (event, status before or None for any, status after).
STEPS = [("submit", None, 10), ("start", 10, 20), ("complete", 20, 40), ("fail", None, 30), ("cancel", None, 50)]


def statuses(events: DataFrame) -> DataFrame:
    """(task_id, status, changes): a task's status after each micro-batch of events (task_id, ts, kind)."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        status, changes = state.get if state.exists else (0, 0)
        rows = sorted((t, k) for b in batches for t, k in zip(b["us"].tolist(), b["kind"].tolist(), strict=True))
        for _, kind in rows:
            for event, before, after in STEPS:
                if kind == event and before in (None, status) and status != after:
                    status, changes = after, changes + 1
                    break
        state.update((status, changes))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "changes": [changes]})

    rows = events.select("task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind").groupBy("task_id")
    return rows.applyInPandasWithState(step, "task_id bigint, status int, changes int", "status int, changes int", "update", "NoTimeout")


def counts_by_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events by kind in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: a task's events in sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "task_id").agg(F.count(F.lit(1)).alias("n")).select("task_id", F.col("session_window.start").alias("start"), "n")


def poll(source: DataFrame, name: str, mode: str = "append", every: str | None = "5 seconds") -> StreamingQuery:
    """Starts a query into memory; without ``every`` it takes what is there and stops."""
    writer = source.writeStream.format("memory").queryName(name).outputMode(mode)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
