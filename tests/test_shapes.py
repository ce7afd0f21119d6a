"""Shapefiles written and read back, in ranges and zipped; foreign records; DXF text."""

from __future__ import annotations

import os
import random
import struct

import pytest

from skyquarry.sources import shapes as sh

SCHEMA = "parts array<array<struct<x:double,y:double>>>, id bigint, level double, name string"


def lines(n=200):
    rng = random.Random(1)
    part = lambda: [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(rng.randrange(2, 9))]
    out = [([part() for _ in range(rng.randrange(1, 4))], k, rng.gauss(0, 1e6), f"línea {k}" if k % 7 else None) for k in range(n)]
    return [*out, (None, None, None, "x" * 300), ([], 5, 0.1, "ü" * 200), ([[(1.0, 2.0), (3.0, 4.0)]], -(2**60), -0.0, "")]



def key(r):
    return repr(r)


def test_lines_round_trip_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sh, "RANGE", 17)
    path = str(tmp_path / "layer")
    assert sh.write_shapefile(spark.createDataFrame(lines(), SCHEMA).repartition(3), path) == len(lines())
    assert len([f for f in os.listdir(path) if f.endswith(".shp")]) == 3 and len(os.listdir(path)) == 9
    got = sh.read_shapefile(spark, path)
    assert got.dtypes[2:] == [("id", "bigint"), ("level", "double"), ("name", "string")]
    cut = lambda t: (t.encode()[:254].decode(errors="ignore") or None) if t else None
    want = sorted((((r[0] or []), r[1], None if r[2] is None else float("%.15e" % r[2]), cut(r[3])) for r in lines()), key=key)
    have = sorted(([[(p.x, p.y) for p in part] for part in r.parts], r.id, r.level, r.name) for r in got.where("id IS NOT NULL").collect())
    assert sorted(have, key=key) == [r for r in want if r[1] is not None]
    assert {r.kind for r in got.collect()} == {"line", None}


@pytest.mark.parametrize("kind,parts", [(sh.POINT, [[(1.5, -2.5)]]), (sh.POLYGON, [[(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]])])
def test_points_and_polygons(spark, tmp_path, kind, parts):
    path = str(tmp_path / "layer")
    sh.write_shapefile(spark.createDataFrame([(parts, 1)], "parts array<array<struct<x:double,y:double>>>, id bigint").coalesce(1), path, kind)
    row = sh.read_shapefile(spark, path).first()
    assert row.kind == sh.KINDS[kind] and [[tuple(p) for p in part] for part in row.parts] == parts


def test_headers_are_what_the_format_says(spark, tmp_path):
    path = str(tmp_path / "layer")
    sh.write_shapefile(spark.createDataFrame([([[(1.0, 2.0), (3.0, 5.0)]], 1), ([[(-1.0, 0.0), (0.0, 9.0)]], 2)], "parts array<array<struct<x:double,y:double>>>, id bigint").coalesce(1), path)
    stem = sh._stems(path)[0]
    raw = open(f"{stem}.shp", "rb").read()
    assert struct.unpack_from(">i", raw)[0] == 9994 and struct.unpack_from(">i", raw, 24)[0] * 2 == len(raw)
    assert struct.unpack_from("<2i4d", raw, 28) == (1000, 3, -1.0, 0.0, 3.0, 9.0)
    index = open(f"{stem}.shx", "rb").read()
    at, size = struct.unpack_from(">2i", index, 108)
    assert struct.unpack_from(">2i", raw, at * 2) == (2, size) and len(index) == 116
    z = struct.pack("<i4d2i", 13, 0, 0, 1, 1, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", 0, 0, 1, 1) + struct.pack("<2d2d", 0, 9, 5, 9)
    assert sh.parts_of(z) == (3, [[(0.0, 0.0), (1.0, 1.0)]])  # a line with heights
    with pytest.raises(ValueError):
        sh.parts_of(struct.pack("<i", 31) + bytes(60))


def test_zip_of_a_layer_and_overlay(spark, tmp_path):
    path, out = str(tmp_path / "layer"), str(tmp_path / "layer.zip")
    sh.write_shapefile(spark.createDataFrame(lines(20), SCHEMA).coalesce(1), path)
    sh.zipped(spark, path, out)
    assert sh.overlay(spark, out, str(tmp_path / "un")).count() == 23
    with pytest.raises(ValueError):
        sh.overlay(spark, out, str(tmp_path / "un2"), most=10)


def test_dxf_and_empty_layers(spark, tmp_path):
    df = spark.createDataFrame([([[(1.0, 2.0), (3.0, 4.5)], [(0.0, 0.0)]], 7.5)], "parts array<array<struct<x:double,y:double>>>, level double")
    sh.write_dxf(df, str(tmp_path / "d"), "contours", "level")
    text = "\n".join(open(tmp_path / "d" / f).read().strip("\n") for f in sorted(os.listdir(tmp_path / "d")) if f.startswith("part") and os.path.getsize(tmp_path / "d" / f))
    assert text.split("\n") == "0 SECTION 2 ENTITIES 0 LWPOLYLINE 8 contours 90 2 38 7.5 10 1.0 20 2.0 10 3.0 20 4.5 0 ENDSEC 0 EOF".split()
    assert sh.write_shapefile(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")) == 0
    assert sh.read_shapefile(spark, str(tmp_path / "e")).collect() == []
