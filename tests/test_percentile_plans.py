from __future__ import annotations

import contextlib
import io

from skyquarry.operators import raster


def test_percentiles_of_few_large_groups_do_not_move_pixels(spark):
    pixels = spark.createDataFrame([(g, float(i * 7 % 101)) for g in "ab" for i in range(101)], "raster string, v double")
    out = raster.statistics(pixels, "v", ["raster"])
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert "SortMergeJoin" not in plan.getvalue()
    assert sorted((r.raster, r.n, r.min, r.max, r.p2, r.p98) for r in out.collect()) == [(g, 101, 0.0, 100.0, 2.0, 98.0) for g in "ab"]
