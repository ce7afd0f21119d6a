"""Rules of a task's life: what is due, what happens next, what is removed. Time is always a parameter."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Task statuses and pending actions.
QUEUED, RUNNING, FAILED, COMPLETED, CANCELED = 10, 20, 30, 40, 50
CANCEL, REMOVE, RESTART, RESIZE, IMPORT, COMPACT = 1, 2, 3, 4, 5, 6


def pending() -> Column:
    """Is a task due? It needs a node, or has one and isn't finished, or has an action pending; partial ones never are."""
    needs = F.col("node_id").isNull() & F.col("auto_node")
    goes_on = F.col("node_id").isNotNull() & (F.col("status").isNull() | F.col("status").isin(QUEUED, RUNNING))
    return ~F.col("partial") & (needs | goes_on | F.col("pending_action").isNotNull())


def next_state(online: Column, reported: Column) -> dict[str, Column]:
    """(status, node_id, pending_action, error) after one tick, from the columns status, node_id, pending_action, auto_node.

    online: is the assigned node (null: none free) online; reported: the status that it reports.
    """
    s, a, n = F.col("status"), F.col("pending_action"), F.col("node_id")
    is_ = lambda code: F.coalesce(a == code, F.lit(False))
    over = F.coalesce(s.isin(FAILED, CANCELED), F.lit(False))
    away = n.isNotNull() & F.col("auto_node") & ~over & ~F.coalesce(online, F.lit(False))
    queued, running = F.coalesce(s == QUEUED, F.lit(False)), F.coalesce(s == RUNNING, F.lit(False))
    none = F.lit(None).cast("int")
    status = (
        F.when(is_(CANCEL), F.lit(CANCELED))
        .when(is_(RESTART), none)
        .when(away & queued, none)
        .when(away & running, F.lit(FAILED))
        .when(n.isNotNull() & s.isNull(), F.lit(QUEUED))
        .when(queued | running, F.coalesce(reported, s))
        .otherwise(s)
    )
    node = F.when(away & queued, F.lit(None).cast("bigint")).otherwise(n)
    error = F.when(away & running & ~is_(CANCEL) & ~is_(RESTART), F.lit("Processing node went offline"))
    return {"status": status.cast("int"), "node_id": node, "pending_action": F.when(is_(REMOVE), a).otherwise(none), "error": error}


def best_nodes(nodes: DataFrame, grants: DataFrame, offline_minutes: int = 5) -> DataFrame:
    """(user_id, node_id): for each user the permitted online node with the shortest queue, the least id on ties.

    nodes(id, queue_count, minutes_ago), grants(user_id, object_id).
    """
    online = nodes.where(F.coalesce(F.col("minutes_ago") < offline_minutes, F.lit(False)))
    both = online.join(grants.select("user_id", F.col("object_id").alias("id")).distinct(), "id")
    return both.groupBy("user_id").agg(F.min(F.struct("queue_count", "id")).alias("m")).select("user_id", F.col("m.id").alias("node_id"))


def expired_partial(tasks: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    return tasks.where(F.col("partial") & (F.col("created_at") <= now - F.expr(f"INTERVAL {hours} HOURS")))


def removable_projects(projects: DataFrame, tasks: DataFrame, now: Column | None = None, hours: int | None = None) -> DataFrame:
    """Projects marked for deletion that are empty; with hours, also empty old ones of owners with zero quota."""
    empty = projects.join(tasks.select("project_id").distinct(), F.col("id") == F.col("project_id"), "left_anti")
    old = F.lit(False) if hours is None else (F.col("quota") == 0) & (F.col("created_at") <= now - F.expr(f"INTERVAL {hours} HOURS"))
    return empty.where(F.col("deleting") | old)


def stale_files(files: DataFrame, now: Column) -> DataFrame:
    """Temporary files older than 24 hours, cached ones older than 30 days: files(path, modified)."""
    age = now.cast("double") - F.col("modified").cast("timestamp").cast("double")
    return files.where(F.when(F.contains("path", F.lit("/cache/")), age > 30 * 86400).otherwise(age > 24 * 3600))


def throttled(events: DataFrame, seconds: float, key: str = "task_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Of each key's events in time order, those at least so long after the last one kept.

    Rows reach a task sorted; only the last kept time of the present key is held.
    """
    names = [key, time, tie]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column("_us").to_pylist(), strict=True):
                new = k != now or last is None
                ok = at is not None and (new or at - last >= seconds * 1e6)
                if new:
                    now, last = k, None
                if ok:
                    last = at
                keep.append(ok)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    rows = events.select(*names, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"))
    return rows.repartition(key).sortWithinPartitions(key, "_us", tie).mapInArrow(run, rows.drop("_us").schema)


def assembled(chunks: DataFrame) -> DataFrame:
    """chunks(upload, total, idx, data) to (upload, data) of the uploads that are complete; repeated chunks count once."""
    parts = chunks.dropDuplicates(["upload", "idx"]).groupBy("upload", "total").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("p"))
    return parts.where("n = total").select("upload", F.array_join(F.transform("p", lambda c: c["data"]), "").alias("data"))


def retries_left(failures: Column, most: int = 5) -> Column:
    return failures < most


#: Actions that a task waits for, and statuses.
REMOVE, RESIZE, FAILED, COMPLETED = 2, 4, 30, 40


def task_signals(before: Column, after: Column, action: Column, copied: Column, node_gone: Column) -> Column:
    """The signals that a change of a task sends, in order, as an array of names."""
    turned = lambda status: F.coalesce((after == status) & ~before.eqNullSafe(F.lit(status)), F.lit(False))
    name = lambda when, text: F.when(when, F.lit(text))
    return F.array_compact(
        F.array(
            name(copied, "task_duplicated"), name(action == RESIZE, "task_resizing_images"), name(turned(COMPLETED), "task_completed"), name(turned(FAILED), "task_failed"),
            name(action == REMOVE, "task_removing"), name(action == REMOVE, "task_removed"), name(node_gone, "processing_node_removed"),
        )
    )
