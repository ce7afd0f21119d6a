"""Streams whose rows wait for each other, up to a deadline in event time: chunked uploads, partial tasks, cached usage.

Each is a processor with its own state by key and timers on the watermark; batch
rules of the same meaning are in operators.lifecycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _ms(column: str = "ts"):
    return F.unix_millis(F.col(column).cast("timestamp"))


class _Timed(StatefulProcessor):
    """One deadline a key: a later call moves it."""

    def _until(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Assembly(_Timed):
    """Chunks by place, until all are there or the deadline passes; what comes after the end is left out until then."""

    def __init__(self, deadline_ms: int):
        self.deadline = deadline_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "idx bigint", "data string, ms bigint")
        self.upload = handle.getValueState("upload", "total bigint, first bigint, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, first, done = self.upload.get() if self.upload.exists() else (None, None, False)
        for b in rows:
            for i, data, ms, n in zip(b["idx"].tolist(), b["data"].tolist(), b["ms"].tolist(), b["total"].tolist(), strict=True):
                total, first = n if total is None else max(total, n), ms if first is None else min(first, ms)
                if not done and (not self.chunks.containsKey((i,)) or self.chunks.getValue((i,)) > (data, ms)):
                    self.chunks.updateValue((i,), (data, ms))
        self._until(first + self.deadline)
        self.upload.update((total, first, done))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, first, _ = self.upload.get()
        parts = {k[0]: v[0] for k, v in self.chunks.iterator() if v[1] <= first + self.deadline}
        whole = len(parts) == total
        self.chunks.clear()
        self.upload.clear()
        yield pd.DataFrame({"upload": [key[0]], "data": ["".join(parts[i] for i in sorted(parts)) if whole else None], "complete": [whole]})


def assembled_uploads(chunks: DataFrame, deadline: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(upload, data, complete) of a stream chunks(upload, total, idx, data, ts), once an upload's deadline has passed.

    The deadline counts from an upload's first chunk; a chunk after it counts for
    nothing, and an upload that lacks one then is dropped (null data).  Chunks may
    come in any order, and again: the least of a place stays.  Rows that are later than the
    watermark allows, and null uploads, places or times, are left out.
    """
    rows = chunks.where("upload IS NOT NULL AND idx IS NOT NULL AND ts IS NOT NULL AND total IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("upload", F.col("total").cast("bigint"), F.col("idx").cast("bigint"), F.coalesce("data", F.lit("")).alias("data"), "ts", _ms().alias("ms"))
    with_state_store(chunks.sparkSession)
    return rows.groupBy("upload").transformWithStateInPandas(Assembly(_milliseconds(deadline)), "upload string, data string, complete boolean", "Append", "EventTime")


def assembled_by(chunks: DataFrame, deadline: str = "1 hour") -> DataFrame:
    """The same of a table: (upload, data, complete)."""
    rows = chunks.where("upload IS NOT NULL AND idx IS NOT NULL AND ts IS NOT NULL AND total IS NOT NULL").withColumn("ms", _ms())
    ends = rows.groupBy("upload").agg((F.min("ms") + _milliseconds(deadline)).alias("end"), F.max("total").cast("bigint").alias("total"))
    parts = rows.drop("total").join(ends, "upload").groupBy("upload", "total", "end", "idx").agg(F.min(F.when(F.col("ms") <= F.col("end"), F.coalesce("data", F.lit("")))).alias("data"), F.min("ms").alias("ms"))
    parts = parts.groupBy("upload", "total").agg(F.count(F.when(F.col("ms") <= F.col("end"), 1)).alias("n"), F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("p"))
    whole = F.col("n") == F.col("total")
    text = F.array_join(F.transform(F.filter("p", lambda c: c["data"].isNotNull()), lambda c: c["data"]), "")
    return parts.select("upload", F.when(whole, text).alias("data"), whole.alias("complete"))


class Expiry(_Timed):
    """A partial task's deadline; any later row that isn't partial lifts it."""

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, partial boolean, created bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        for b in rows:
            last = max([*([last] if last else []), *zip(b["ms"].tolist(), b["partial"].tolist(), b["created"].tolist(), strict=True)])
        self.last.update(tuple(last))
        self._until(max(last[2] + self.hours * 3_600_000, last[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, partial, created = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"task_id": [key[0]] * bool(partial), "created": [created] * bool(partial)})


def expired_tasks(changes: DataFrame, hours: int = 72, late: str = "1 hour") -> DataFrame:
    """(task_id, created_at) of tasks that are still partial so long after their creation: of a stream changes(task_id, partial, created_at, ts)."""
    rows = changes.where("task_id IS NOT NULL AND ts IS NOT NULL AND created_at IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("task_id", F.coalesce("partial", F.lit(False)).alias("partial"), _ms("created_at").alias("created"), "ts", _ms().alias("ms"))
    with_state_store(changes.sparkSession)
    out = rows.groupBy("task_id").transformWithStateInPandas(Expiry(hours), "task_id bigint, created bigint", "Append", "EventTime")
    return out.select("task_id", F.timestamp_millis("created").alias("created_at"))


class Cache(_Timed):
    """A running total, and what of it was last told: told again until it is too old."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "total double")
        self.told = handle.getValueState("told", "value double, until bigint")
        self.waiting = handle.getListState("waiting", "ms bigint, ask boolean, amount double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in zip(b["ms"].tolist(), b["ask"].tolist(), b["amount"].tolist(), strict=True)]
        self.waiting.appendList(new)
        timers = list(self.handle.listTimers())
        first = min(r[0] for r in new)
        if not timers or first < min(timers):
            self._until(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed, in order of time: sizes before questions of the same moment."""
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        total = self.total.get()[0] if self.total.exists() else 0.0
        value, until = self.told.get() if self.told.exists() else (0.0, -1)
        out = []
        for ms, ask, amount in (r for r in waiting if r[0] <= now):
            if not ask:
                total += amount
                continue
            if ms >= until:
                value, until = total, ms + self.ttl
            out.append((ms, value))
        rest = [r for r in waiting if r[0] > now]
        self.total.update((total,))
        self.told.update((value, until))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ms": [o[0] for o in out], "usage": [o[1] for o in out]})


def cached_usage(events: DataFrame, ttl: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, ts, usage): the answer to each question of a stream events(user_id, ts, ask, amount).

    A question is answered with the sum of the amounts so far, or with the last
    answer if that is not yet as old as ``ttl``.
    """
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("user_id", "ts", _ms().alias("ms"), F.coalesce("ask", F.lit(False)).alias("ask"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"))
    with_state_store(events.sparkSession)
    out = rows.groupBy("user_id").transformWithStateInPandas(Cache(_milliseconds(ttl)), "user_id bigint, ms bigint, usage double", "Append", "EventTime")
    return out.select("user_id", F.timestamp_millis("ms").alias("ts"), "usage")


def usage_at(events: DataFrame) -> DataFrame:
    """The uncached answers of a table, for comparison: (user_id, ts, usage)."""
    w = Window.partitionBy("user_id").orderBy("ts", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("usage", F.sum(F.when(F.col("ask"), 0.0).otherwise(F.col("amount"))).over(w)).where("ask").select("user_id", "ts", "usage")


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)
