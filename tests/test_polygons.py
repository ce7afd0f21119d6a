"""Many polygons at once against pixel by pixel, and against one polygon at a time."""

from __future__ import annotations

import math
import random

import pytest

from skyquarry.operators import polygons as pg
from skyquarry.operators import terrain as te

RINGS = "id bigint, ring array<struct<x:double,y:double>>"


def rings():
    rng = random.Random(4)
    out = []
    for k in range(25):
        cx, cy, n = rng.uniform(3, 17), rng.uniform(3, 17), rng.randrange(3, 9)
        corners = [(round(cx + rng.uniform(1, 6) * math.cos(2 * math.pi * i / n), 2), round(cy + rng.uniform(1, 6) * math.sin(2 * math.pi * i / n), 2)) for i in range(n)]
        out.append((k, [(min(max(x, 0.0), 19.9), min(max(y, 0.0), 19.9)) for x, y in corners]))
    out += [(30, [(2.0, 2.0), (8.0, 2.0), (8.0, 6.0), (2.0, 6.0)]), (31, [(2.5, 2.5), (8.5, 2.5), (8.5, 6.5), (2.5, 6.5), (2.5, 2.5)]), (32, [(1.0, 1.0), (10.0, 10.0), (10.0, 1.0), (1.0, 10.0)]), (33, None), (34, [(1.0, 1.0), (2.0, 2.0)]), (35, []), (36, [(3.2, 3.2), (3.3, 3.2), (3.3, 3.4)])]
    return out


def grid(spark):
    rng = random.Random(9)
    z = {(x, y): None if rng.random() < 0.05 else round(rng.random() * 30, 3) for x in range(20) for y in range(20)}
    return z, spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "x bigint, y bigint, z double").repartition(3)


def inside(px, py, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > py) != (by > py) and px < (py - ay) * ((bx - ax) / (by - ay)) + ax:
            odd = not odd
    return odd


def meets(x, y, ring):
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        side = [(px - ax) * (by - ay) - (py - ay) * (bx - ax) for px in (x, x + 1) for py in (y, y + 1)]
        if x <= max(ax, bx) and x + 1 >= min(ax, bx) and y <= max(ay, by) and y + 1 >= min(ay, by) and min(side) <= 0 <= max(side):
            return True
    return False


@pytest.mark.parametrize("rule", ["centre", "touched"])
def test_pixel_by_pixel(spark, rule):
    z, dem = grid(spark)
    found = {(r.id, r.x, r.y, r.z) for r in pg.in_polygons(dem, spark.createDataFrame(rings(), RINGS), rule).collect()}
    assert found == {(k, x, y, v) for k, ring in rings() if ring and len(ring) > 2 for (x, y), v in z.items() if inside(x + 0.5, y + 0.5, ring) or (rule == "touched" and meets(x, y, ring))}


def test_spans_are_disjoint_and_holes_are_rings_of_the_same_id(spark):
    figure = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (1, [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)])]
    got = sorted((r.y, r.a, r.b) for r in pg.spans(spark.createDataFrame(figure, RINGS)).collect())
    assert got == sorted((y, a, b) for y in range(10) for a, b in ([(0, 2), (6, 9)] if 3 <= y < 6 else [(0, 9)]))


@pytest.mark.parametrize("method", ["average", "highest", "lowest", "custom", "plane", "triangulate"])
def test_volumes_as_one_at_a_time(spark, method):
    z, dem = grid(spark)
    some = [(k, r) for k, r in rings() if r and len(r) > 2 and k not in (32, 36)][::4]
    found = {r.id: r for r in pg.volumes(dem, spark.createDataFrame(some, RINGS), method, custom=10.0, pixel_area=0.25).collect()}
    assert set(found) == {k for k, _ in some}
    for k, ring in some:
        want = te.volume(dem, ring if ring[0] != ring[-1] else ring[:-1], method, custom=10.0, pixel_area=0.25).first()
        assert found[k].n == want.n
        assert (found[k].volume is None) == (want.volume is None) and (want.volume is None or abs(found[k].volume - want.volume) < 1e-3)


def test_odd_tables(spark):
    _, dem = grid(spark)
    odd = spark.createDataFrame([(33, None), (35, []), (37, [(-5.0, -5.0), (4.0, -5.0), (4.0, 4.0)]), (38, [(50.0, 50.0), (60.0, 50.0), (60.0, 60.0)])], RINGS)
    got = {r.id: (r.n > 0, r.volume) for r in pg.volumes(dem, odd, "average").collect()}
    assert got == {33: (False, None), 35: (False, None), 37: (True, None), 38: (False, None)}
    assert pg.volumes(dem, spark.createDataFrame([], RINGS), "plane").collect() == []
    with pytest.raises(ValueError):
        pg.volumes(dem, odd, "unknown")


def test_many_polygons_on_one_place_are_dealt_over_tasks(spark, monkeypatch):
    """No task joins the spans of a row of pixels on its own: the matches of 400 equal polygons lie in several tasks."""
    monkeypatch.setattr(pg, "SPANS", 50, raising=False)
    z, dem = grid(spark)
    same = [(k, [(2.0, 3.0), (7.0, 3.0), (7.0, 4.0), (2.0, 4.0)]) for k in range(400)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from pyspark.sql import functions as F

        found = pg.in_polygons(dem, spark.createDataFrame(same, RINGS)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.id, r.x, r.y, r.z) for r in found if r.z is not None) == sorted((k, x, 3, z[x, 3]) for k in range(400) for x in range(2, 7) if z[x, 3] is not None)
    assert len(found) == 2000
    assert len({r.task for r in found}) > 1
