"""Streams with timers against the batch rules, with rows out of order and again, and over several micro-batches."""

from __future__ import annotations

import datetime
import random
import time

from pyspark.sql import functions as F

from skyquarry.streaming import timers

T0 = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC).timestamp()


def streamed(spark, tmp_path, rows, end, schema, make, name, files=3):
    """The stream's rows, its source in several files that come one by one, and one far in the future that closes all."""
    for part in [*(rows[k::files] for k in range(files)), end]:
        time.sleep(1.1)  # files come in the order of their time
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(name)


def test_uploads_are_assembled_or_dropped(spark, tmp_path):
    rng, rows = random.Random(1), []
    for u in range(12):
        n, start = rng.randrange(1, 5), T0 + rng.randrange(0, 300)
        for i in range(n):
            if u % 4 != 3 or i:  # some lack a chunk
                late = 4000 if u % 5 == 4 and i == n - 1 else 0  # some come after the deadline
                rows += [(f"u{u}", n, i, f"{u}.{i};", start + rng.randrange(0, 200) + late)] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    end = [("end", 1, 0, "", T0 + 10**6), (None, 1, 0, "x", T0), ("u0", 1, None, "x", T0)]
    schema = "upload string, total int, idx int, data string, s double"
    got = streamed(spark, tmp_path, rows, end, schema, lambda s: timers.assembled_uploads(s, "1 hour", "3 hours"), "uploads").where("upload <> 'end'").collect()
    want = timers.assembled_by(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")), "1 hour").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.complete for r in want} == {True, False}


def test_partial_tasks_expire(spark, tmp_path):
    rows = [(1, True, T0, T0), (2, True, T0, T0), (2, False, T0, T0 + 7200), (3, False, T0, T0), (4, True, T0 + 100, T0 + 50), (5, True, T0, T0 + 10), (5, True, T0, T0 + 20), (6, None, T0, T0), (None, True, T0, T0)]
    end = [(99, False, T0, T0 + 10**7)]
    schema = "task_id bigint, partial boolean, c double, s double"
    make = lambda s: timers.expired_tasks(s.withColumn("created_at", F.timestamp_seconds("c")), 72, "4 hours")
    assert sorted(r.task_id for r in streamed(spark, tmp_path, rows, end, schema, make, "expired").collect()) == [1, 4, 5]


def test_usage_is_told_again_until_it_is_old(spark, tmp_path):
    rng, rows = random.Random(4), []
    for user in range(5):
        for t in sorted(rng.sample(range(0, 12000), 30)):
            rows.append((user, rng.random() < 0.5, float(rng.randrange(100)), T0 + t))
    rng.shuffle(rows)
    want = []
    for user in range(5):
        total, value, until = 0.0, 0.0, -1.0
        for _, ask, amount, s in sorted((r for r in rows if r[0] == user), key=lambda r: (r[3], r[1])):
            if ask:
                value, until = (total, s + 1800) if s >= until else (value, until)
                want.append((user, s, value))
            else:
                total += amount
    schema = "user_id bigint, ask boolean, amount double, s double"
    got = streamed(spark, tmp_path, rows, [(99, True, 0.0, T0 + 10**6)], schema, lambda s: timers.cached_usage(s, "30 minutes", "4 hours"), "usage").where("user_id < 99")
    assert sorted((r.user_id, r.s, r.usage) for r in got.withColumn("s", F.unix_millis("ts") / 1000).collect()) == sorted(want)
    exact = timers.usage_at(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")))
    assert exact.count() == len(want)
