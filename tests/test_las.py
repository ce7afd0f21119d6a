"""LAS folders: round trips, ranges, the header's fields, later formats."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pytest

from skyquarry.sources import las

SCHEMA = "x double, y double, z double, red int, green int, blue int, intensity int, class int"


def cloud(n=500):
    rng = random.Random(1)
    return [(round(500000 + rng.random() * 900, 3), round(4e6 + rng.random() * 900, 3), round(rng.gauss(0, 50), 3), *(rng.randrange(65536) for _ in range(4)), rng.randrange(32)) for _ in range(n)]


def test_round_trip_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(las, "RANGE", 70)
    rows = [*cloud(), (None, 1.0, 1.0, 1, 1, 1, 1, 1)]
    path = str(tmp_path / "c")
    assert las.write_las(spark.createDataFrame(rows, SCHEMA).repartition(3), path) == 500 and len(os.listdir(path)) == 3
    got = sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.red, r.green, r.blue, r.intensity, r["class"]) for r in las.read_las(spark, path).collect())
    assert got == sorted(cloud())


def test_without_colours_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1.25, -2.5, 3.0), (1.0, -2.0, None), (float("nan"), 0.0, 0.0)], "x double, y double, z double")
    assert las.write_las(df, str(tmp_path / "c")) == 1
    assert [tuple(r) for r in las.read_las(spark, str(tmp_path / "c")).collect()] == [(1.25, -2.5, 3.0, 0, 0, 0, 0, 0)]
    assert las.write_las(df.where("false"), str(tmp_path / "e")) == 0 and las.read_las(spark, str(tmp_path / "e")).collect() == []
    with pytest.raises(ValueError):
        las.write_las(spark.createDataFrame([(0.0, 0.0, 0.0), (1e9, 0.0, 0.0)], "x double, y double, z double"), str(tmp_path / "w"))


def test_header_and_later_formats(spark, tmp_path):
    path = str(tmp_path / "c")
    las.write_las(spark.createDataFrame(cloud(9), SCHEMA).coalesce(1), path)
    raw = open(f"{path}/{os.listdir(path)[0]}", "rb").read()
    assert raw[:4] == b"LASF" and (raw[24], raw[25]) == (1, 2) and len(raw) == 227 + 9 * 26
    assert struct.unpack_from("<H2I", raw, 94) == (227, 227, 0) and struct.unpack_from("<BHI", raw, 104) == (2, 26, 9)
    assert struct.unpack_from("<2d", raw, 179) == pytest.approx((max(r[0] for r in cloud(9)), min(r[0] for r in cloud(9))))
    points = np.zeros(2, las.record_type(7, 36))
    points["x"], points["class"], points["red"] = [10, 20], 6, 7
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HI", head, 94, 375, 375)
    struct.pack_into("<BHI", head, 104, 7, 36, 0)
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 100, 0, 0)
    struct.pack_into("<Q", head, 247, 2)
    (tmp_path / "new.las").write_bytes(bytes(head) + points.tobytes())
    assert [(r.x, r.red, r["class"]) for r in las.read_las(spark, str(tmp_path / "new.las")).collect()] == [(105.0, 7, 6), (110.0, 7, 6)]
    head[104] |= 0x80
    with pytest.raises(ValueError):
        las.header_of(bytes(head))
