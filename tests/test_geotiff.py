"""GeoTIFF folders: round trips of all types, overviews, foreign layouts, tiles skipped, tasks that run twice."""

from __future__ import annotations

import io
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

from skyquarry.sources import geotiff as g


def pixels(spark, seed=1, w=70, h=50, x0=-20, y0=-9, bands=1, whole=False):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.1 else float(rng.randrange(256)) if whole else rng.gauss(0, 50)
    rows = [(x, y, *(value() for _ in range(bands))) for x in range(x0, x0 + w) for y in range(y0, y0 + h) if rng.random() < 0.95]
    return rows, spark.createDataFrame(rows, "x bigint, y bigint, " + ", ".join(f"v{k} double" for k in range(bands))).repartition(4)


def there(df, bands=1):
    return {(r.x, r.y): tuple(r[2 : 2 + bands]) for r in df.collect() if any(v is not None for v in r[2 : 2 + bands])}


@pytest.mark.parametrize("dtype,bands,nodata", [("float64", 1, None), ("float32", 2, None), ("uint8", 3, 0.0), ("uint8", 4, None), ("int16", 1, -9999.0), ("float64", 1, -1e9)])
def test_what_is_written_is_read(spark, tmp_path, dtype, bands, nodata):
    rows, df = pixels(spark, bands=bands, whole=dtype.startswith(("u", "i")))
    options = {"dtype": dtype, "tile": 16, "levels": 2, "epsg": 32632} | ({} if nodata is None else {"nodata": nodata})
    g.write_geotiff(df, str(tmp_path / "r"), [f"v{k}" for k in range(bands)], file=32, **options)
    assert len(os.listdir(tmp_path / "r")) == 3 * 3 and all(f.endswith(".tif") for f in os.listdir(tmp_path / "r"))
    found = g.read_geotiff(spark, str(tmp_path / "r"))
    got = there(found, bands)
    for x, y, *v in rows:
        for k, want in enumerate(v):
            have = got.get((x, y), (None,) * bands)[k]
            if want is None or (nodata is not None and want == nodata):
                assert have in ((None,) if dtype.startswith("f") or nodata is not None else (0.0,))
            else:
                assert have == (float(np.float32(want)) if dtype == "float32" else want)


def test_overviews_are_means_of_the_level_before(spark, tmp_path):
    rows, df = pixels(spark)
    g.write_geotiff(df, str(tmp_path / "r"), ["v0"], file=32, tile=8, levels=3)
    now = {(x, y): v for x, y, v in rows if v is not None}
    for level in (1, 2, 3):
        groups: dict = {}
        for (x, y), v in now.items():
            groups.setdefault((x // 2, y // 2), []).append(v)
        now = {k: sum(v) / len(v) for k, v in groups.items()}
        got = {k: v[0] for k, v in there(g.read_geotiff(spark, str(tmp_path / "r"), level)).items()}
        assert got.keys() == now.keys() and max(abs(got[k] - now[k]) for k in now) < 1e-9


def test_tiles_outside_are_not_read(spark, tmp_path):
    _, df = pixels(spark, w=64, h=64, x0=0, y0=0)
    path = str(tmp_path / "r")
    g.write_geotiff(df, path, ["v0"], file=32, tile=8, levels=0)
    reader = g.GeoTiffReader(path, 0)
    list(reader.pushFilters([GreaterThan(("x",), 39), LessThan(("x",), 50), EqualTo(("y",), 3), GreaterThan(("b1",), 0)]))
    assert [os.path.basename(p.path)[:6] for p in reader.partitions()] == ["x32_y0"]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 2 and {min(b.column("x").to_pylist()) for b in batches} == {40, 48}
    for f in g._files(path):  # whatever Spark hands down must keep it from the spoilt tiles
        with open(f.path, "rb") as handle:
            tags = g.Tiff(handle).level(0)
        spoilt = tags[g.TILE_AT][0]
        with open(f.path, "r+b") as handle:
            handle.seek(spoilt)
            handle.write(b"spoilt")
    assert g.read_geotiff(spark, path).where("x >= 40 and x < 64 and y > 8").count() > 0
    with pytest.raises(Exception):
        g.read_geotiff(spark, path).count()


def foreign(order, big, planar, predictor, compression, strips, n=2, w=21, h=13):
    """A file as other programs write them."""
    a = np.random.default_rng(3).integers(0, 60000, (h, w, n)).astype(np.uint16)
    rows_of = 5
    parts = []
    for band in [slice(None)] if planar == 1 else [slice(k, k + 1) for k in range(n)]:
        if strips:
            cut = [a[r : r + rows_of, :, band] for r in range(0, h, rows_of)]
        else:
            full = np.zeros((16, 32, n), np.uint16)
            full[:h, :w] = a
            cut = [full[:16, c : c + 16, band] for c in (0, 16)]
        for p in cut:
            p = np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1])) if predictor == 2 else p
            raw = p.astype(np.dtype(f"{order}u2")).tobytes()
            parts.append(zlib.compress(raw) if compression == 8 else raw)
    wide, fmt = ("Q", 16) if big else ("I", 4)
    size = 8 if not big else 16
    ats = [size + sum(map(len, parts[:k])) for k in range(len(parts))]
    tags = {256: ("H", [w]), 257: ("H", [h]), 258: ("H", [16] * n), 259: ("H", [compression]), 277: ("H", [n]), 284: ("H", [planar]), 317: ("H", [predictor])}
    tags |= {273: (wide, ats), 278: ("H", [rows_of]), 279: (wide, [len(p) for p in parts])} if strips else {322: ("H", [16]), 323: ("H", [16]), 324: (wide, ats), 325: (wide, [len(p) for p in parts])}
    body = b"".join(parts)
    at = size + len(body)
    head = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, at) if big else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at)
    entry, more = b"", b""
    room = at + (8 if big else 2) + len(tags) * (20 if big else 12) + (8 if big else 4)
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = struct.pack(f"{order}{len(values)}{kind}", *values)
        fits = len(raw) <= (8 if big else 4)
        own = raw.ljust(8 if big else 4, b"\0") if fits else struct.pack(f"{order}{wide}", room + len(more))
        more += b"" if fits else raw
        entry += struct.pack(f"{order}HH{wide}", tag, {"H": 3, "I": fmt, "Q": 16}[kind], len(values)) + own
    return a, head + body + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entry + struct.pack(f"{order}{wide}", 0) + more


@pytest.mark.parametrize("order,big,planar,predictor,compression,strips", [("<", False, 1, 1, 1, True), (">", False, 1, 2, 8, True), ("<", True, 2, 2, 8, False), (">", True, 1, 1, 8, False), ("<", False, 2, 1, 1, True)])
def test_layouts_of_others(order, big, planar, predictor, compression, strips):
    a, raw = foreign(order, big, planar, predictor, compression, strips)
    got = np.full(a.shape, -1.0)
    for b in g.pixels_of(g.Tiff(io.BytesIO(raw)), 0, (-1e9, 1e9, -1e9, 1e9)):
        for k in range(a.shape[2]):
            got[b.column("y").to_numpy(), b.column("x").to_numpy(), k] = b.column(f"b{k + 1}").to_numpy()
    assert (got == a).all()


def test_large_files_are_dealt_and_tasks_may_run_twice(spark, tmp_path, monkeypatch):
    rows, df = pixels(spark)
    path = str(tmp_path / "r")
    for _ in range(2):
        g.write_geotiff(df, path, ["v0"], file=32, tile=8, levels=1)
    assert there(g.read_geotiff(spark, path)) == {(x, y): (v,) for x, y, v in rows if v is not None}
    monkeypatch.setattr(g, "SPLIT", 100)
    monkeypatch.setattr(g, "RANGE", 3)
    reader = g.GeoTiffReader(path, 0)
    parts = reader.partitions()
    assert len(parts) > 30
    seen = [(x, y) for p in parts for b in reader.read(p) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
    assert len(seen) == len(set(seen)) and {(x, y) for x, y, _ in rows} <= set(seen)


def test_nothing_and_wrong_sizes(spark, tmp_path):
    empty = spark.createDataFrame([], "x bigint, y bigint, v0 double")
    g.write_geotiff(empty, str(tmp_path / "e"), ["v0"])
    assert g.read_geotiff(spark, str(tmp_path / "e")).collect() == []
    with pytest.raises(ValueError):
        g.write_geotiff(empty, str(tmp_path / "e"), ["v0"], file=100, tile=16)
