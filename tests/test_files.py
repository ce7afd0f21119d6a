from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyquarry.sources import files, sinks, store


def test_ground_control_file(spark, tmp_path):
    (tmp_path / "gcp.txt").write_text("\n\nEPSG:32615\n\n# comment\n1 2 3 4 8 tiny.JPG\nbad line\n5 6 7 8.5 9 b.jpg extra\n")
    rows = files.ground_control_file(spark, str(tmp_path / "gcp.txt")).orderBy("line_no").collect()
    assert [(r.srs, r.px, r.filename, r.extras) for r in rows] == [("EPSG:32615", 4.0, "tiny.JPG", ""), ("EPSG:32615", 8.5, "b.jpg", "extra")]


def test_overlay_lines_and_listing(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    [r] = files.overlay(spark, str(tmp_path / "o.json")).collect()
    assert r.type == "Point" and json.loads(r.coordinates) == [1, 2]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/x.log").write_text("a\nb\n")
    assert [r.line for r in files.console_lines(spark, str(tmp_path / "logs")).orderBy("line_no").collect()] == ["a", "b", ""]
    (tmp_path / "logs/y.JPG").write_bytes(b"123")
    assert [r.size for r in files.images(files.listing(spark, str(tmp_path / "logs"))).collect()] == [3]


def test_memory_stats(spark):
    lines = spark.createDataFrame([("MemTotal:  100 kB",), ("MemFree: 20 kB",), ("Buffers: 5 kB",), ("Cached: 5 kB",), ("Other: x",)], "value string")
    assert tuple(files.memory_stats(lines).first()) == (100, 30, 70)


def test_exports(spark, tmp_path):
    pixels = spark.range(100).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"), F.col("id").cast("double").alias("z"))
    sinks.export_raster(pixels, str(tmp_path / "r"), block=4)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "r")).collect())) == sorted(map(tuple, pixels.collect()))
    for fmt in ("csv", "parquet", "ply"):
        sinks.export_points(pixels, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 100
    with pytest.raises(ValueError):
        sinks.export_points(pixels, str(tmp_path / "las"), "las")
    owners = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id long, owner_id long, name string")
    sinks.dump_by_owner(owners, str(tmp_path / "dump"))
    back = sinks.restore_dump(spark, str(tmp_path / "dump"), "id long, name string, owner_id long")
    assert sorted((r.id, r.owner_id, r.name) for r in back.collect()) == [(1, 5, "a"), (2, 6, "b")]


def test_store(spark):
    schema = "key string, user_id long, int_value int, float_value double, bool_value boolean, string_value string, json_value string"
    rows = spark.createDataFrame([], schema)
    get = lambda r, *a, **k: store.value_of(r, *a, **k).first().value
    assert get(rows, "a", "k", "int", default=7) == 7 and rows.count() == 0
    one = store.set_value(rows, "a", "k", "int", F.lit(3), user=1)
    two = store.set_value(one, "a", "k", "string", F.lit("x"), user=1)
    assert get(two, "a", "k", "int", user=1) == 3 and get(two, "a", "k", "string", user=1) == "x" and two.count() == 1
    assert get(two, "a", "k", "int", user=2) is None and get(two, "b", "k", "int", user=1) is None and get(two, "a", "k", "int") is None
    with pytest.raises(ValueError):
        store.value_of(rows, "a", "k", "blob")


def test_detection_hook(spark):
    import pandas as pd

    found = sinks.detections(spark.createDataFrame([("a", b"12"), ("b", b"1")], "path string, content binary"), lambda b: pd.DataFrame({"path": b["path"], "n": b["content"].map(len)}), "path string, n long")
    assert sorted(map(tuple, found.collect())) == [("a", 2), ("b", 1)]


def test_a_log_is_no_file_of_its_own(spark, tmp_path):
    """Files are bounded by partitions; logs keep their order, lines without a number come last."""
    rows = [(str(i % 500), i, f"line {i}") for i in range(3000)] + [("7", None, None)]
    path = str(tmp_path / "logs")
    sinks.write_logs(spark.createDataFrame(rows, "task string, at bigint, line string"), path)
    assert len(list((tmp_path / "logs").rglob("*.parquet"))) <= 64
    lines = files.log_lines(spark, path)
    assert lines.count() == 3001
    found = files.last_lines(lines, 2).where("task in ('7', '8')").orderBy("task", "line_no").collect()
    assert [(r.task, r.line_no, r.line) for r in found] == [("7", 5, "line 2507"), ("7", 6, None), ("8", 4, "line 2008"), ("8", 5, "line 2508")]


def test_console_slice_writes_few_files(spark, tmp_path):
    from skyquarry import plans

    events = spark.range(1200).select(F.col("id").alias("event_id"), (F.col("id") % 400).alias("user_id"), F.lit("click").alias("event_type"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    files_of = lambda: set(shared.glob("logs-*/**/part-*"))
    before = files_of()
    assert plans.runnable()["s19_console_slice"](spark, str(tmp_path)).count() == 1200
    assert 0 < len(files_of() - before) <= 64
