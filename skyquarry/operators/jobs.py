"""Work that outlives a request: leases, schedules with an expiry, shipped functions and their results."""

from __future__ import annotations

import inspect
import textwrap
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds after which a lease is stale, and between two heartbeats.
STALE_AFTER, HEARTBEAT = 30.0, 5.0
#: Seconds between two runs of a job, and after which one that hasn't started is dropped.
SCHEDULES = {
    "update-nodes-info": (30, 14),
    "cleanup-projects": (60, 29),
    "cleanup-tasks": (3600, 1799),
    "cleanup-tmp-directory": (3600, 1799),
    "cleanup-cache-directory": (21600, 10799),
    "process-pending-tasks": (5, 2),
    "check-quotas": (3600, 1799),
}


def _seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def leased(updated_at: Column, now: Column, stale: float = STALE_AFTER) -> Column:
    """Is a lease held? Without an update it isn't; one older than ``stale`` seconds is free to take."""
    return F.coalesce(_seconds(now) - _seconds(updated_at) <= stale, F.lit(False))


def lease_periods(beats: DataFrame, key: str = "task_id", time: str = "ts", stale: float = STALE_AFTER) -> DataFrame:
    """(key, taken, until, beats): heartbeats united to periods in which the lease was held; a gap of more than ``stale`` seconds ends one."""
    w = Window.partitionBy(key).orderBy(time)
    gap = _seconds(F.col(time)) - _seconds(F.lag(time).over(w))
    rows = beats.where(F.col(time).isNotNull()).select(key, time).withColumn("_new", F.when(gap <= stale, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    until = F.timestamp_micros((F.unix_micros(F.max(time).cast("timestamp")) + F.lit(int(stale * 1e6))).cast("bigint"))
    return rows.groupBy(key, "_run").agg(F.min(time).alias("taken"), until.alias("until"), F.count(F.lit(1)).alias("beats")).drop("_run")


def expired(due: Column, started: Column, window: Column) -> Column:
    """Is a job dropped? It hasn't started within its window after it was due; one that never started is."""
    return F.coalesce(_seconds(started) - _seconds(due) > window, F.lit(True))


def due_runs(job: Column, at: Column) -> tuple[Column, Column]:
    """The latest time at which a job of SCHEDULES was due, and its window in seconds; null for unknown jobs."""
    pick = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for name, v in SCHEDULES.items() for x in (name, v[k]))), job)
    every = pick(0)
    return F.timestamp_seconds(F.floor(_seconds(at) / every) * every), pick(1)


def ship_function(function: Callable | str) -> tuple[str, str]:
    """(source, name) of a function that imports all it needs in its body: what a worker needs to run it."""
    if isinstance(function, str):
        return function, ""
    return textwrap.dedent(inspect.getsource(function)), function.__name__


RESULT = "job bigint, output string, file binary, error string, progress double, status string"


def run_shipped(calls: DataFrame, functions: dict[str, tuple[str, str]]) -> DataFrame:
    """Runs shipped functions on the executors: calls(job, function, argument) to (job, output, file, error, progress, status).

    A function gets its argument and ``progress``, a callback of (status, percent)
    whose last values are returned.  It returns bytes (a file), a string, or None.
    What it raises, and an unknown function, is an error; other calls go on.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Callable] = {}
        for batch in batches:
            rows = []
            for job, name, argument in zip(batch["job"], batch["function"], batch["argument"], strict=True):
                last: dict = {"status": None, "progress": None}

                def progress(status, percent, last=last):
                    last.update(status=str(status), progress=float(percent))

                try:
                    if name not in known:
                        source, entry = functions[name]
                        space: dict = {}
                        exec(compile(source, name, "exec"), space)  # noqa: S102  the caller's own function
                        known[name] = space[entry]
                    found = known[name](argument, progress)
                    file = bytes(found) if isinstance(found, (bytes, bytearray)) else None
                    rows.append((job, None if file is not None or found is None else str(found), file, None, last["progress"], last["status"]))
                except Exception as e:  # noqa: BLE001  any failure is the call's result
                    rows.append((job, None, None, f"{type(e).__name__}: {e}", last["progress"], last["status"]))
            yield pd.DataFrame(rows, columns=["job", "output", "file", "error", "progress", "status"])

    return calls.select(F.col("job").cast("bigint").alias("job"), "function", "argument").mapInPandas(run, RESULT)


def result_state(output: Column, file: Column, error: Column, started: Column) -> tuple[Column, Column]:
    """(ready, kind) of a job's row: an error comes first, then a file, then an output; one that only started isn't ready."""
    kind = F.when(error.isNotNull(), F.lit("error")).when(file.isNotNull(), F.lit("file")).when(output.isNotNull(), F.lit("output")).when(started, F.lit("pending")).otherwise(F.lit("unknown"))
    return kind.isin("error", "file", "output"), kind


class Extension(ABC):
    """What a further package adds: columns by name, and rows that react to signals."""

    name: str

    @abstractmethod
    def columns(self) -> dict[str, Callable[..., Column]]:
        """Functions of columns, by the name they are mounted under."""

    def on_signal(self, signals: DataFrame) -> DataFrame | None:
        """What follows from signals(kind, task_id, ts); None if it takes no notice."""
        return None


class Platform(ABC):
    """A service that holds image sets: five questions that an implementation answers as Columns or relations."""

    @abstractmethod
    def recognises(self, url: Column) -> Column: ...

    @abstractmethod
    def listing_url(self, url: Column) -> Column: ...

    @abstractmethod
    def image_urls(self, listing: DataFrame) -> DataFrame: ...

    @abstractmethod
    def folder_name(self, url: Column) -> Column: ...

    @abstractmethod
    def form_fields(self) -> list[str]: ...


class Registry:
    """Extensions by name; a name is taken once."""

    def __init__(self):
        self.extensions: dict[str, Extension] = {}

    def add(self, extension: Extension) -> None:
        if extension.name in self.extensions:
            raise ValueError(f"{extension.name!r} is registered twice")
        self.extensions[extension.name] = extension

    def column(self, path: str, *args) -> Column:
        """The column of ``extension/function``."""
        name, _, function = path.partition("/")
        return self.extensions[name].columns()[function](*args)

    def signal(self, signals: DataFrame) -> dict[str, DataFrame]:
        found = {k: x.on_signal(signals) for k, x in self.extensions.items()}
        return {k: v for k, v in found.items() if v is not None}
