"""Every registered query against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

import importlib

import duckdb
import pytest

from skyquarry import plans

#: Queries that SQL can't express, and the test that holds each against a brute-force version.
BRUTE_FORCE = {
    "k03_contour_features": "test_raster.test_contour_features_are_the_lines",
    "k05_shaded_tiles": "test_raster.test_shaded_tiles_pixel_by_pixel",
    "m14_hsv_blend": "test_raster.test_hsv_blend_against_colorsys",
    "r13_reprojected_bilinear": "test_clouds.test_values_of_the_target",
    "r13_reprojected_nearest": "test_clouds.test_values_of_the_target",
    "k03_contour_shapefile": "test_shapes.test_lines_round_trip_in_ranges",
    "r17_sampled_points": "test_clouds.test_sample_as_one_by_one",
    "r10_breached": "test_depressions.test_as_one_queue_does",
    "r10_breached_accumulation": "test_depressions.test_no_inner_pits_are_left",
    "r06_volume_triangulated": "test_raster.test_triangulated_volume_pixel_by_pixel",
    "r08_contour_lines": "test_raster.test_contour_lines_against_one_stitch",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def show(x):
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(show, x)) + "]"
    return f"{type(x).__name__}:{x}"


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.runnable()))
def test_query(spark, sf_dir, duck, name):
    df = plans.runnable()[name](spark, sf_dir)
    rows = df.collect()
    if name not in plans.SQL:
        module, test = BRUTE_FORCE[name].split(".")
        assert rows and hasattr(importlib.import_module(f"tests.{module}"), test)
        return
    found = duck.execute(plans.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, rows) == bag(columns, found.fetchall())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(plans.runnable()) == set(plans.SQL) | set(BRUTE_FORCE)
    assert set(plans.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
