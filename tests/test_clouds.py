"""Sampling by radius against taking points one by one; reprojection against the transform itself."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skyquarry.functions import geometry as g
from skyquarry.operators import clouds, reproject


def cloud(seed, n):
    rng = random.Random(seed)
    hot = [(1.0 + rng.random() * 0.2, 1.0 + rng.random() * 0.2, 1.0) for _ in range(n // 3)]
    wide = [(round(rng.uniform(-6, 6), 2), round(rng.uniform(-6, 6), 2), round(rng.uniform(0, 2), 2)) for _ in range(n)]
    return [*hot, *wide, *wide[:20], (None, 1.0, 1.0), (1.0, float("nan"), 2.0)]


@pytest.mark.parametrize("radius", [0.5, 3.0])
def test_sample_as_one_by_one(spark, radius):
    rows = [(*p, f"c{k}", k) for k, p in enumerate(cloud(2, 400))]
    df = spark.createDataFrame(rows, "x double, y double, z double, _o string, cx int").repartition(4)
    clean = df.where("x IS NOT NULL AND NOT isnan(y)").withColumn("h", F.xxhash64("x", "y", "z"))
    kept = []
    for r in sorted({(r.h, r.x, r.y, r.z) for r in clean.collect()}):
        if all(sum((a - b) ** 2 for a, b in zip(r[1:], k, strict=True)) >= radius * radius for k in kept):
            kept.append(r[1:])
    found = clouds.sampled(df, radius).collect()
    assert sorted((r.x, r.y, r.z) for r in found) == sorted(kept)
    least = {}
    for *p, c, k in rows:
        least[tuple(p)] = min(least.get(tuple(p), (c, k)), (c, k))
    assert all((r["_o"], r["cx"]) == least[r.x, r.y, r.z] for r in found)
    assert clouds.sampled(df.where("false"), radius).collect() == []


def test_export_of_a_cloud(spark):
    df = spark.createDataFrame(cloud(3, 200), "x double, y double, z double")
    out = clouds.translated(df, 1.0, (F.col("x") * 2 + 100, F.col("y") * 2), [(95.0, -5.0), (105.0, -5.0), (105.0, 5.0), (95.0, 5.0)])
    want = {(r.x * 2 + 100, r.y * 2, r.z) for r in clouds.sampled(df, 1.0).collect() if 95 <= r.x * 2 + 100 < 105 and -5 <= r.y * 2 < 5}
    assert {tuple(r) for r in out.collect()} == want and want


def test_utm_and_back(spark):
    df = spark.createDataFrame([(9.0 + k / 7, -60.0 + 5 * k) for k in range(20)], "lon double, lat double")
    south = F.col("lat") < 0
    x, y = g.to_utm(F.col("lon"), F.col("lat"), 32, south)
    lon, lat = g.from_utm(F.col("x"), F.col("y"), 32, south)
    rows = df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect()
    assert max(max(abs(r.lon - r.lon2), abs(r.lat - r.lat2)) for r in rows) < 2e-8


SOURCE = reproject.Grid(8.2, 46.9, 0.004, 0.003, 120, 90)
FORWARD = lambda lon, lat: g.to_utm(lon, lat, 32)
BACKWARD = lambda x, y: g.from_utm(x, y, 32)


def raster(spark):
    rng = random.Random(5)
    z = {(x, y): None if rng.random() < 0.03 else round(rng.random() * 50, 2) for x in range(120) for y in range(90)}
    return z, spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "x bigint, y bigint, z double")


def test_target_grid_holds_the_source(spark):
    target = reproject.target_grid(spark, SOURCE, FORWARD)
    assert abs(math.hypot(target.width, target.height) / math.hypot(120, 90) - 1) < 0.02
    x, y = target.pixel(*FORWARD(*SOURCE.place(F.col("c"), F.col("r"))))
    ends = spark.createDataFrame([(a * 12.0, b * 9.0) for a in range(11) for b in range(11)], "c double, r double").select(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()
    assert ends.a >= -0.05 and ends.c >= -0.05 and ends.b <= target.width + 0.05 and ends.d <= target.height + 0.05


@pytest.mark.parametrize("tolerance,block", [(0.125, 64), (1e-4, 32)])
def test_positions_are_as_near_as_asked(spark, tolerance, block):
    target = reproject.target_grid(spark, SOURCE, FORWARD)
    found = reproject.source_positions(spark, SOURCE, target, BACKWARD, tolerance, block)
    sx, sy = SOURCE.pixel(*BACKWARD(*target.place(F.col("x") + 0.5, F.col("y") + 0.5)))
    off = found.select(F.greatest(F.abs(sx - F.col("sx")), F.abs(sy - F.col("sy"))).alias("off")).agg(F.max("off").alias("m"), F.count("off").alias("n")).first()
    assert off.m <= tolerance * 1.01 and off.n > 0.9 * 120 * 90
    exact = spark.range(target.width * target.height).select((F.col("id") % target.width).alias("x"), F.floor(F.col("id") / target.width).alias("y")).select("x", "y", sx.alias("sx"), sy.alias("sy"))
    safe = lambda df, m: df.where(f"sx > {m} AND sx < 120 - {m} AND sy > {m} AND sy < 90 - {m}").select("x", "y")
    assert safe(exact, tolerance).exceptAll(found.select("x", "y")).isEmpty()
    assert found.count() == found.select("x", "y").distinct().count()


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_values_of_the_target(spark, method):
    z, pixels = raster(spark)
    target = reproject.target_grid(spark, SOURCE, FORWARD, 320.0)
    found = {(r.x, r.y): r.z for r in reproject.reprojected(pixels, SOURCE, target, BACKWARD, method, 1e-6, 16).collect()}
    where = {(r.x, r.y): (r.sx, r.sy) for r in reproject.source_positions(spark, SOURCE, target, BACKWARD, 1e-6, 16).collect()}
    assert set(found) == set(where)
    for c, (sx, sy) in where.items():
        if method == "nearest":
            assert found[c] == z[math.floor(sx), math.floor(sy)]
            continue
        px, py = math.floor(sx - 0.5), math.floor(sy - 0.5)
        four = [z.get((px + i, py + j)) for j in (0, 1) for i in (0, 1)]
        if None in four:
            assert found[c] is None
        else:
            u, v = sx - 0.5 - px, sy - 0.5 - py
            assert abs(found[c] - ((four[0] * (1 - u) + four[1] * u) * (1 - v) + (four[2] * (1 - u) + four[3] * u) * v)) < 1e-9
