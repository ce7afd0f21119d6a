"""Views by rings against one pass over all cells, for several bands and segments."""

from __future__ import annotations

import random

import pytest

from skyquarry.operators import views

SCHEMA = "x bigint, y bigint, z double"


def expected(z, ox, oy, height=1.7, radius=None):
    eye, hides, out = z[ox, oy] + height, {}, {(ox, oy): 255}
    for x, y in sorted(z, key=lambda c: max(abs(c[0] - ox), abs(c[1] - oy))):
        dx, dy = x - ox, y - oy
        r, t = max(abs(dx), abs(dy)), min(abs(dx), abs(dy))
        if r == 0 or (radius is not None and dx * dx + dy * dy > radius * radius):
            continue
        line = views.FREE
        if r > 1:
            back = lambda d: d - (d > 0) + (d < 0)
            diagonal = hides.get((ox + back(dx), oy + back(dy)), views.FREE)
            straight = hides.get((ox + back(dx), y) if abs(dx) >= abs(dy) else (x, oy + back(dy)), views.FREE)
            share = r if t == r else t
            line = max((diagonal * share * (t > 0) + straight * (r - t) * (t < r)) / (r - 1), views.FREE)
        rise = None if z[x, y] is None else z[x, y] - eye
        hides[x, y] = line if rise is None else max(rise, line)
        if rise is not None:
            out[x, y] = 255 if rise >= line - 1e-9 else 0
    return out


def grid(seed, w, h):
    rng = random.Random(seed)
    return {(x, y): None if rng.random() < 0.05 else round(rng.random() ** 4 * 12 + 0.01 * (x - w / 2) ** 2 + 0.01 * y * y, 3) for x in range(w) for y in range(h)}


@pytest.mark.parametrize("ox,oy,band,segment,radius", [(11, 9, 3, 4, None), (0, 0, 5, 5, None), (21, 30, 256, 1024, None), (5, 20, 4, 9, 12)])
def test_as_one_pass_sees(spark, ox, oy, band, segment, radius):
    z = grid(ox, 24, 37)
    z[ox, oy] = 3.0
    rows = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], SCHEMA)
    found = {(r.x, r.y): r.visible for r in views.viewshed(rows, ox, oy, radius=radius, band=band, segment=segment).collect()}
    want = expected(z, ox, oy, radius=radius)
    assert found == want
    assert 0.1 < sum(v == 0 for v in want.values()) / len(want) < 0.99


def test_a_wall_hides_what_lies_behind(spark):
    z = {(x, y): 50.0 if x == 5 else 0.0 for x in range(12) for y in range(9)}
    seen = {(r.x, r.y): r.visible for r in views.viewshed(spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], SCHEMA), 2, 4).collect()}
    assert all((v == 255) == (x <= 5) for (x, _), v in seen.items())


def test_no_observer_no_rows(spark):
    assert views.viewshed(spark.createDataFrame([], SCHEMA), 0, 0).collect() == []
    assert views.viewshed(spark.createDataFrame([(0, 0, None), (1, 0, 2.0)], SCHEMA), 0, 0).collect() == []
    assert [tuple(r) for r in views.viewshed(spark.createDataFrame([(0, 0, 1.0)], SCHEMA), 0, 0).collect()] == [(0, 0, 255)]


def test_a_narrow_grid_takes_few_bands(spark):
    """Bands follow the cells, not the rings: 301 rings of 7 cells, the observer's ring aside, in bands of 4 rings at least."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    bands_of = lambda: set(shared.glob("skyquarry-*/seen/band=*"))
    z = grid(3, 7, 303)
    z[2, 1] = 3.0
    rows, before = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], SCHEMA), bands_of()
    found = {(r.x, r.y): r.visible for r in views.viewshed(rows, 2, 1, band=4, segment=4, most=500).collect()}
    assert found == expected(z, 2, 1)
    assert 3 <= len(bands_of() - before) <= 4


def test_bands_hold_a_bounded_number_of_cells():
    assert views._bands([(0, 9), (1, 9), (2, 9), (3, 99), (5, 9)], 10, 300) == [(0, 2, 9), (3, 3, 99), (5, 5, 9)]
