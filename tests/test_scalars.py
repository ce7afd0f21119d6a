from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyquarry.functions import geometry as g
from skyquarry.functions import scalars as s
from skyquarry.functions import units


def values(spark, make, *rows):
    kind = "double" if isinstance(next(r for r in rows if r is not None), float) else "long" if isinstance(next(r for r in rows if r is not None), int) else "string"
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_labels(spark):
    h = 3600.0
    assert values(spark, s.grace_label, 73 * h, 71 * h, 47.9 * h, 3.1 * h, 1.51 * h, 0.99 * h, 0.0) == ["in 3 days", "in 2 days", "in 47 hours", "in 3 hours", "in 90 minutes", "in 59 minutes", "very soon"]
    assert values(spark, s.disk_size, 500.0, 1000.0, 1_000_000.0, 2_500_000.0, 3e9) == ["0.5 GB", "1.0 GB", "1000.0 GB", "2.5 TB", "3.0 PB"]
    assert values(spark, s.duration, 0, -1, 1000, 59_999, 3_599_999, 360_000_000_000) == ["-- : -- : --", "-- : -- : --", "00:00:01", "00:01:00", "01:00:00", "100000:00:00"]
    assert values(spark, s.bytes_label, 0, 999, 1000, 1500, 999_999, 1_000_000, 10**12) == ["0 bytes", "999 bytes", "1 KB", "1.5 KB", "1000 KB", "1 MB", "1 TB"]
    assert values(spark, lambda v: units.label(v, "meters"), 1234.5, 1000.0, 0.12345) == ["1,234.5 m", "1,000 m", "0.123 m"]


def test_names_and_ids(spark):
    assert values(spark, s.short_id, 0, 1, 35, 36, 1295, 1296, 10**12) == ["a", "b", "9", "ba", "99", "baa", "m1oggsj2"]
    assert values(spark, s.version_number, "1.2.3", "1", "1.2.3.4", "wrong", "1.x") == [100203, 100000, 100203, -1, -1]
    assert values(spark, lambda v: s.download_name(v, F.lit("all.zip")), "My task / 1!", "a--b") == ["My-task-1-all.zip", "a-b-all.zip"]
    assert values(spark, s.lenient_tags, '["a","b"]', "bad", None) == [["a", "b"], [], []]
    assert values(spark, s.tags_to_array, "a  b ", "", None) == [["a", "b"], [], []]
    assert values(spark, s.mapped_file, "x_gcp_list (1).txt", "a.jpg") == ["gcp_list.txt", "a.jpg"]


def test_ground_control(spark):
    out = values(spark, s.ground_control, "1 2 3 4 5 a.jpg x y", "1 hello 3 hello 5 6", "1 2 3", "# 1 2 3 4 5 6", "")
    assert out[0].filename == "a.jpg" and out[0].extras == "x y" and out[1:] == [None] * 4
    assert values(spark, s.ground_control_problem, "1 2 3 4 5 a", "1 b 3 4 5 a", "1") == [None, "y is not a number", "too few entries"]


def test_dataset_urls(spark):
    def parts(v):
        return F.array(*s.dataset_url(v).values())

    assert values(spark, parts, "ddb://hub.x.org/me/data", "ddb+unsafe://h:5/r/me/data", "https://h/r/me/data?x", "junk") == [
        ["https://hub.x.org", "me", "data"], ["http://h:5", "me", "data"], ["https://h", "me", "data"], [None, None, None],
    ]


def test_numbers(spark):
    row = spark.range(1).select(
        s.decimal_degrees(F.lit(10), F.lit(30), F.lit(36.0), F.lit("S")).alias("d"), s.percentage(F.lit(5), F.lit(0)).alias("p"), s.resize_ratio(F.lit(100), F.lit(50), 200).alias("r"),
        s.reductions(F.lit(2.6**3 * 100), 100.0).alias("n"), s.resized(F.lit(1), F.lit(0.1)).alias("side"), *(x.alias(n) for n, x in zip(("eh", "ev"), s.control_errors(F.lit(0.1), F.lit(-0.5), F.lit(-2.0)), strict=True)),
    ).first()
    assert tuple(row) == (pytest.approx(-10.51), 100.0, 1.0, 3, 1, 0.1, 2.0)


def test_geometry(spark):
    rings = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 1.0, 9.0), ([(5.0, 0.0), (6.0, 0.0), (5.0, 1.0)], 1.0, 9.0), (None, 1.0, 9.0), ([(0.0, 0.0), (4.0, 0.0), (2.0, 4.0)], 1.0, None)], "ring array<struct<x:double,y:double>>, a double, b double")
    box = F.struct(F.lit(1.0).alias("x0"), F.col("a").alias("y0"), F.lit(3.0).alias("x1"), F.col("b").alias("y1"))
    cut = [r.c for r in rings.select(g.clipped(F.col("ring"), box).alias("c")).collect()]
    assert {(round(p.x, 9), round(p.y, 9)) for p in cut[0]} == {(1, 1), (3, 1), (3, 4), (1, 4)} and cut[1:] == [None, None, None]
    wkt = 'COMPD_CS["x",PROJCS["u",GEOGCS["g",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32615"]],VERT_CS["v",AUTHORITY["EPSG","5773"]],AUTHORITY["EPSG","9999"]]'
    assert g.epsg_of(wkt) == 32615 and g.epsg_of('GEOGCS["g",AUTHORITY["EPSG","4326"]]') == 4326 and g.epsg_of("LOCAL") is None
    t = (0.5, 0, 10, 0, -0.5, 20)
    a, b, c, d, e, f = g.inverse_affine(t)
    assert (a * 12 + b * 15 + c, d * 12 + e * 15 + f) == pytest.approx((4, 10))


def test_utm(spark):
    rows = spark.createDataFrame([(9.0, 45.0), (9.0, 0.0), (10.5, 45.0), (7.5, -45.0)], "lon double, lat double")
    east, north = g.to_utm(F.col("lon"), F.col("lat"), g.utm_zone(F.col("lon")), F.col("lat") < 0)
    (e1, n1), (e2, n2), (e3, n3), (e4, n4) = (tuple(r) for r in rows.select(east, north).collect())
    assert (e1, n1) == pytest.approx((500000, 4982950.400), abs=1e-3) and (e2, n2) == pytest.approx((500000, 0), abs=1e-6)  # the arc of the meridian to 45 degrees
    assert (e3 - 500000, n3) == pytest.approx((500000 - e4, 10000000 - n4), abs=1e-6) and 118000 < e3 - 500000 < 118300
