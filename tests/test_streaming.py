from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyquarry.operators import lifecycle as li
from skyquarry.streaming import lifecycle as sl


@pytest.fixture
def events(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "event_id")
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def finish(query):
    query.awaitTermination(120)
    query.stop()


def test_throttle_equals_batch(spark, events):
    batch, stream = events
    finish(sl.poll(sl.throttle(stream, 3600.0), "throttled", every=None))
    got = sorted(map(tuple, spark.table("throttled").select("task_id", "ts").collect()))
    want = sorted(map(tuple, li.throttled(batch, 3600.0).select("task_id", "ts").collect()))
    assert got == want and 0 < len(got) < batch.count()


def test_status_machine(spark, tmp_path):
    rows = [(1, 1, "submit"), (1, 2, "start"), (1, 3, "complete"), (2, 1, "complete"), (2, 2, "fail"), (3, 1, "submit"), (3, 2, "complete")]
    df = spark.createDataFrame(rows, "task_id long, s long, kind string").select("task_id", F.timestamp_seconds("s").alias("ts"), "kind")
    df.write.parquet(str(tmp_path / "in"))
    finish(sl.poll(sl.statuses(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "statuses", "update", every=None))
    assert sorted(map(tuple, spark.table("statuses").collect())) == [(1, 40, 3), (2, 30, 1), (3, 10, 1)]


def test_windows_and_sessions(spark, events):
    batch, stream = events
    finish(sl.poll(sl.counts_by_window(stream), "windows", every=None))
    windows = spark.table("windows").agg(F.sum("n")).first()[0]
    assert 0 < windows <= batch.count()
    finish(sl.poll(sl.sessions(stream), "sessions", every=None))
    assert spark.table("sessions").count() > 0


def test_due_tasks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, True, False, None), (2, 5, 40, True, False, None), (3, 5, 20, False, True, None), (4, 5, 40, False, False, 2)], "id long, node_id long, status int, auto_node boolean, partial boolean, pending_action int")
    df.write.parquet(str(tmp_path / "in"))
    finish(sl.poll(sl.due_tasks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "due", every=None))
    assert sorted(r.id for r in spark.table("due").collect()) == [1, 4]


def test_batch_rules(spark):
    chunks = spark.createDataFrame([("u", 2, 1, "b"), ("u", 2, 0, "a"), ("u", 2, 0, "a"), ("v", 2, 0, "x")], "upload string, total long, idx long, data string")
    assert [tuple(r) for r in li.assembled(chunks).collect()] == [("u", "ab")]
