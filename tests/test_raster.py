from __future__ import annotations

import colorsys
import itertools
import json
import math
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquarry.functions import color, units
from skyquarry.functions.ieee import clean, divide
from skyquarry.operators import formulas, raster, terrain
from skyquarry.sources import sinks


def column(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_binding():
    make, formula, at = formulas.bind("_TESTRB", "BGR")
    assert at == [1, 3] and formula.range == (0.0, 1.0)
    assert formulas.bind("_TESTRB", "NRB")[2] == [2, 3] and formulas.bind("_TESTRB", None)[2] == [1, 3]
    for bad in (("_TESTRB", "NRG"), ("nope", "RGB")):
        with pytest.raises(ValueError):
            formulas.bind(*bad)
    assert formulas.filters_for("VARI", 3) == ["RGB"]


def test_auto_order():
    full = [(d, d) for d in ("red", "green", "blue", "nir", "alpha")]
    assert formulas.auto_order(full, "NDVI") == ("RGBN", True) and formulas.auto_order(full, "Celsius") == ("L", False) and formulas.auto_order(full, "VARI") == ("RGBN", True)
    bare = [("b", None)] * 4 + [("alpha", None)]
    assert formulas.auto_order(bare, "NDVI") == ("RGN", False) and formulas.auto_order(bare, "VARI") == ("RGB", False)
    assert "_TESTRB" not in formulas.available(3) and "NDRE" not in formulas.available(3)


def test_division_and_cleaning(spark):
    v = lambda a, b: column(spark, divide(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert math.isnan(v(0.0, 0.0)) and v(1.0, 0.0) == math.inf and v(-1.0, 0.0) == -math.inf and v(None, 1.0) is None and v(3.0, 2.0) == 1.5
    k = lambda x: column(spark, clean(F.lit(x).cast("double")))
    assert k(math.nan) == 0 and k(math.inf) == -9999 and k(-math.inf) == -9999 and k(0.25) == 0.25 and k(None) is None


def test_export_settings():
    assert formulas.export_settings("dsm", "jpg") == {"format": "jpg", "formula": None, "bands": None, "rescale": None, "color_map": "viridis", "hillshade": 6}
    assert formulas.export_settings("orthophoto", "png", "NDVI", "RGN")["rescale"] == (-1.0, 1.0)
    assert formulas.export_settings("orthophoto", "gtiff", rescale=(0, 1))["rescale"] is None
    for bad in ({"fmt": "bmp"}, {"fmt": "png", "formula": "NDVI"}, {"fmt": "png", "bands": "RGB"}, {"fmt": "png", "formula": "NDVI", "bands": "RGB"}):
        with pytest.raises(ValueError):
            formulas.export_settings("orthophoto", **bad)
    assert formulas.needs_no_work("orthophoto", "gtiff") and not formulas.needs_no_work("orthophoto", "gtiff", epsg=4326)
    assert formulas.render_defaults("dsm")["rescale"] == (0.0, 1000.0) and formulas.rgb_positions(["gray", "alpha"]) == [1, 1, 1]


def test_histogram_sums_to_the_valid_count(spark):
    rng = np.random.default_rng(1)
    values = [None, *rng.normal(size=2000).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want, _ = np.histogram(values[1:], 255)
    got = {r.bin: r.n for r in raster.histogram(df, "v", []).collect()}
    assert sum(got.values()) == 2000 and [got.get(i, 0) for i in range(255)] == want.tolist()
    flat = raster.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", []).collect()
    assert [(r.bin, r.n) for r in flat] == [(127, 4)]


@pytest.mark.parametrize(("w", "h", "most", "overlap"), [(100, 70, 32, 0), (100, 70, 32, 5), (10, 10, 32, 0), (64, 64, 32, 0)])
def test_windows_cover_the_raster(spark, w, h, most, overlap):
    seen = np.zeros((h, w), int)
    for r in raster.subwindows(spark, w, h, most, overlap).collect():
        assert r.w <= most and r.h <= most and r.x + r.w <= w and r.y + r.h <= h
        seen[r.y : r.y + r.h, r.x : r.x + r.w] += 1
    assert seen.min() >= 1


def grid(spark, z):
    return spark.createDataFrame([(x, y, None if math.isnan(z[y, x]) else float(z[y, x])) for y in range(z.shape[0]) for x in range(z.shape[1])], "x long, y long, z double")


def test_gradient_and_plane(spark):
    z = np.random.default_rng(2).normal(size=(7, 9))
    rows = terrain.gradient(grid(spark, z), 0.5, -2.0).collect()
    gy, gx = np.gradient(z, -2.0, 0.5)
    assert all(r.gx == pytest.approx(gx[r.y, r.x]) and r.gy == pytest.approx(gy[r.y, r.x]) for r in rows)
    plane = np.add.outer(np.arange(6) * 0.5, np.arange(5) * 0.25)
    shades = [r.shade for r in terrain.hillshade(grid(spark, plane)).collect()]
    assert max(shades) - min(shades) < 1e-12
    fit = terrain.plane_fit(grid(spark, plane)).first()
    assert (fit.m1, fit.m2, fit.b) == pytest.approx((0.25, 0.5, 0.0), abs=1e-9)
    assert {r.shade for r in terrain.multidirectional(grid(spark, np.zeros((4, 4)))).collect()} == {128.0}


RING = [(1.5, 1.5), (8.5, 1.5), (8.5, 7.5), (1.5, 7.5)]


def test_volumes(spark):
    z = np.full((10, 10), 5.0)
    dem = grid(spark, z)
    assert terrain.volume(dem, RING, "average").first().volume == 0
    n = terrain.volume(dem, RING, "custom", custom=2.0).first()
    assert n.n == 56 and n.volume == pytest.approx(56 * 3.0)
    plane = np.add.outer(np.arange(10) * 0.5, np.arange(10) * 0.25)
    for method in ("plane", "triangulate"):
        assert terrain.volume(grid(spark, plane), RING, method).first().volume == pytest.approx(0, abs=1e-3)
    with pytest.raises(ValueError):
        terrain.volume(dem, RING, "custom")
    with pytest.raises(ValueError):
        terrain.volume(dem, [(0, 0), (50, 0), (0, 50)], "average")


def test_contours_of_a_cone(spark):
    y, x = np.mgrid[0:21, 0:21]
    z = np.hypot(x - 10.0, y - 10.0)
    lines = terrain.contour_lines(terrain.contour_segments(grid(spark, z), 4.0)).collect()
    rings = {r.level: r for r in lines if r.level < 10}
    for level, r in rings.items():
        assert r.length == pytest.approx(2 * math.pi * level, rel=0.05) and r.points[0] == pytest.approx(r.points[-1])
    assert set(rings) == {4.0, 8.0}


def test_drainage(spark):
    y, x = np.mgrid[0:8, 0:8]
    dem = grid(spark, (x + y).astype(float))
    pointer = terrain.d8_pointer(dem)
    acc = {(r.x, r.y): r.cells for r in terrain.accumulation(pointer).collect()}
    assert acc[(0, 0)] == 64 and acc[(7, 7)] == 1
    at = terrain.snap(terrain.accumulation(pointer), 1, 1, 1).first()
    assert (at.x, at.y, at.cells) == (0, 0, 64)
    assert terrain.watershed(pointer, 0, 0).count() == 64 and terrain.watershed(pointer, 3, 3).count() == acc[(3, 3)]


def test_viewshed_behind_a_wall(spark):
    z = np.zeros((9, 9))
    z[:, 5] = 10
    seen = {(r.x, r.y): r.visible for r in terrain.viewshed(grid(spark, z), 2, 4).collect()}
    assert seen[(4, 4)] == 255 and seen[(5, 4)] == 255 and seen[(7, 4)] == 0 and seen[(0, 0)] == 255


def test_viewshed_reaches_every_cell(spark):
    z = np.zeros((3, 80))
    z[:, 60] = 10
    seen = {(r.x, r.y): r.visible for r in terrain.viewshed(grid(spark, z), 2, 1).collect()}
    assert len(seen) == 240 and seen[(59, 1)] == 255 and seen[(60, 1)] == 255 and seen[(79, 1)] == 0
    assert {x for x, _ in ((r.x, r.y) for r in terrain.viewshed(grid(spark, z), 2, 1, radius=30).collect())} == set(range(33))


@given(st.floats(0, 0.999), st.floats(0, 1), st.floats(0, 1))
def test_units_invert(h, s, v):
    for u in units.UNITS:
        assert u.factor > 0
    assert units.BY_NAME["acres"].factor == pytest.approx(1 / 4046.8564224)


def test_hsv_round_trip(spark):
    rows = spark.createDataFrame([(r / 10, g / 10, b / 10) for r in range(11) for g in range(11) for b in range(11)], "r double, g double, b double")
    h, s = color.rgb_to_hs(F.col("r"), F.col("g"), F.col("b"))
    back = color.hsv_to_rgb(h, s, F.greatest("r", "g", "b"))
    for r in rows.select("r", "g", "b", *(c.alias(f"{n}2") for c, n in zip(back, "rgb", strict=True))).collect():
        assert (r.r2, r.g2, r.b2) == pytest.approx((r.r * 255, r.g * 255, r.b * 255), abs=1)


def test_colour_codes(spark):
    r, g, b = color.hex_to_rgb(F.lit("#FF8000"))
    assert column(spark, F.array(r, g, b)) == [255, 128, 0]
    assert column(spark, F.array(*color.hex_to_rgb(F.lit("oops")))) == [255, 255, 255]
    assert column(spark, color.complement(F.lit("#ff8000"))) == "#007fff"
    assert column(spark, color.pack(*(F.lit(255) for _ in range(4)))) == 2**32 - 1


def test_tiles_and_png(spark):
    assert raster.tile_bounds(0, 0, 0) == pytest.approx((-180, -85.0511287798, 180, 85.0511287798))
    assert raster.zoom_window(18, 18) == (15, 21) and raster.tile_zoom(10, 512) == 9
    with pytest.raises(ValueError):
        raster.tile_zoom(3, 100)
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    data = sinks.png(image)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(data[41:-16])[1:13] == image[0].tobytes()
    assert terrain.hillshade_spacing(0.5) == 4.5 and terrain.hillshade_spacing(1.0, zoom=20, most=20) == 16


def test_thinning_and_thumbnail(spark):
    pts = spark.createDataFrame([(0.1, 0.1, 0.0), (0.2, 0.1, 0.0), (1.5, 0.0, 0.0)], "x double, y double, z double")
    assert sorted(tuple(r) for r in terrain.thinned(pts, 1.0).collect()) == [(0.1, 0.1, 0.0), (1.5, 0.0, 0.0)]
    assert terrain.thumbnail(grid(spark, np.zeros((8, 12))), 12, 8, 4).count() == 16


def noise(seed: int, h: int, w: int) -> np.ndarray:
    return np.round(np.random.default_rng(seed).uniform(0, 400, (h, w)), 2)


def whole_lines(segments) -> list[tuple]:
    """(segments, length) of each line, by union of shared ends: a brute-force version for lines without crossings."""
    parent: dict = {}

    def find(p):
        while parent.setdefault(p, p) != p:
            p = parent[p]
        return p

    parts = [((round(r.x0, 9), round(r.y0, 9)), (round(r.x1, 9), round(r.y1, 9)), r.level) for r in segments]
    for a, b, level in parts:
        parent[find((level, a))] = find((level, b))
    found: dict = {}
    for a, b, level in parts:
        k = find((level, a))
        n, length, _ = found.get(k, (0, 0.0, level))
        found[k] = (n + 1, length + math.dist(a, b), level)
    return sorted((level, n + 1, round(length, 6)) for n, length, level in found.values())


def test_contour_lines_against_one_stitch(spark):
    segments = terrain.contour_segments(grid(spark, noise(3, 14, 17)), 100.0)
    lines = terrain.contour_lines(segments).collect()
    assert sorted((r.level, len(r.points), round(r.length, 6)) for r in lines) == whole_lines(segments.collect())
    assert all(r.length == pytest.approx(sum(math.dist(p, q) for p, q in zip(r.points, r.points[1:], strict=False))) for r in lines)
    short = terrain.contour_lines(segments, shortest=3.0, tolerance=0.5).collect()
    assert sorted(round(r.length, 6) for r in short) == sorted(round(r.length, 6) for r in lines if r.length >= 3.0)
    assert sum(len(r.points) for r in short) < sum(len(r.points) for r in lines)


def test_contour_features_are_the_lines(spark):
    lines = terrain.contour_lines(terrain.contour_segments(grid(spark, noise(4, 9, 9)), 200.0))
    want = sorted((r.level, r.points) for r in lines.collect())
    rows = [json.loads(r.value) for r in sinks.geojson_features(lines).collect()]
    assert all(f["type"] == "Feature" and f["geometry"]["type"] == "LineString" for f in rows)
    assert sorted((f["properties"]["level"], f["geometry"]["coordinates"]) for f in rows) == want


def test_several_rasters_at_once(spark):
    one, two = noise(5, 8, 9), noise(6, 8, 9)
    both = grid(spark, one).withColumn("raster", F.lit("a")).union(grid(spark, two).withColumn("raster", F.lit("b")))
    for k, z in (("a", one), ("b", two)):
        own = lambda df, k=k: sorted(tuple(r) for r in df.where(F.col("raster") == k).drop("raster").collect())
        plain = lambda df: sorted(tuple(r) for r in df.collect())
        dem = grid(spark, z)
        assert own(terrain.hillshade(both, key=("raster",))) == plain(terrain.hillshade(dem))
        assert own(terrain.contour_segments(both, 100.0, ("raster",))) == plain(terrain.contour_segments(dem, 100.0))
        acc = terrain.accumulation(terrain.d8_pointer(both, ("raster",)), key=("raster",))
        assert own(acc) == plain(terrain.accumulation(terrain.d8_pointer(dem)))


def test_triangles_have_empty_circles():
    rng = np.random.default_rng(2)
    for n in (3, 4, 9, 25):
        points = [tuple(p) for p in rng.uniform(0, 50, (n, 2)).tolist()]
        want = []
        for t in itertools.combinations(range(n), 3):
            a, b, c = (np.array(points[i]) for i in t)
            m = 2 * np.array([b - a, c - a])
            centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
            r = np.linalg.norm(centre - a)
            if all(np.linalg.norm(centre - points[i]) >= r - 1e-9 for i in range(n) if i not in t):
                want.append(t)
        assert terrain.triangulate(points) == want
    big = [tuple(p) for p in rng.uniform(0, 50, (200, 2)).tolist()]
    assert len(terrain.triangulate(big)) > 300


def test_triangulated_volume_pixel_by_pixel(spark):
    z = noise(7, 10, 10)
    corners = [(math.floor(a), math.floor(b)) for a, b in RING]
    inside = {(r.x, r.y) for r in grid(spark, z).where(terrain.touched(F.col("x"), F.col("y"), RING)).collect()}
    total = 0.0
    for x, y in inside:
        for t in terrain.triangulate(corners):
            m = np.array([[corners[i][0], corners[i][1], 1.0] for i in t]).T
            w = np.linalg.solve(m, [x, y, 1.0])
            if (w >= -1e-9).all():
                total += z[y, x] - sum(w[k] * z[corners[i][1], corners[i][0]] for k, i in enumerate(t))
                break
    assert terrain.volume(grid(spark, z), RING, "triangulate").first().volume == pytest.approx(abs(total), abs=1e-3)


def test_hsv_blend_against_colorsys(spark):
    rows = spark.createDataFrame([(r / 5, g / 5, b / 5, v / 3) for r in range(6) for g in range(6) for b in range(6) for v in range(4)], "r double, g double, b double, v double")
    out = color.hsv_blend(*(F.col(c) for c in "rgbv"))
    for x in rows.select("r", "g", "b", "v", *(c.alias(f"{n}2") for c, n in zip(out, "rgb", strict=True))).collect():
        h, s, _ = colorsys.rgb_to_hsv(x.r, x.g, x.b)
        want = [math.floor(c * 255 + 1e-9) for c in colorsys.hsv_to_rgb(h, s, x.v)]
        assert (x.r2, x.g2, x.b2) == pytest.approx(want, abs=1)


def test_exact_percentiles_of_odd_values(spark):
    rng = np.random.default_rng(9)
    data = {1: rng.normal(size=30_001), 2: np.repeat([1.0, 2.0], 5000), 3: np.array([4.0]), 4: rng.exponential(size=25_000) ** 8}
    rows = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [(1, None), (5, None)], "k int, v double")
    got = {r.k: r.p for r in raster.percentiles(rows, "v", ["k"], [0.02, 0.5, 0.98]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k, x in data.items():
        assert got[k] == pytest.approx(np.percentile(x, [2, 50, 98]).tolist(), rel=1e-12)


def test_shaded_tiles_pixel_by_pixel(spark):
    z = noise(8, 11, 13)
    z[4, 5] = math.nan
    colours = color.PALETTES["discrete_ndvi"]
    dem = terrain.hillshade(grid(spark, z))
    shade = {(r.x, r.y): r.shade for r in dem.collect()}
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in sinks.read_tiles(sinks.map_tiles(dem, F.col("z"), 0.0, 400.0, colours, F.col("shade"), 8), ("r", "g", "b")).collect()}
    want = {}
    for (x, y), s in shade.items():
        if s is not None and not math.isnan(z[y, x]):
            v = int(min(max(z[y, x], 0), 400) * 255 / 400)
            c = colours[min(v * len(colours) // 256, len(colours) - 1)]
            h, sat, _ = colorsys.rgb_to_hsv(*(int(c[i : i + 2], 16) / 255 for i in (1, 3, 5)))
            want[(x, y)] = tuple(k * 255 for k in colorsys.hsv_to_rgb(h, sat, s))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1.001) for k in want)


def test_contour_lines_join_pieces_not_segments(spark, monkeypatch):
    """Rounds of joins take the ends that pieces of lines share: hardly any of a grid of one tile."""
    import math

    from skyquarry.operators import terrain

    seen, rounds = [], terrain._components
    monkeypatch.setattr(terrain, "_components", lambda edges: seen.append(edges.count()) or rounds(edges))
    dem = spark.createDataFrame([(x, y, 10 * math.sin(x / 5) * math.cos(y / 7) + x / 3) for x in range(60) for y in range(50)], "x bigint, y bigint, z double")
    segments = terrain.contour_segments(dem, 2.0)
    lines = terrain.contour_lines(segments).collect()
    total = segments.count()
    assert sum(len(r.points) - 1 for r in lines) == total > 1000
    assert seen[0] < total / 10
