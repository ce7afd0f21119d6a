"""Fill levels and breaching against one queue over the whole grid, for several tile sizes."""

from __future__ import annotations

import heapq
import math
import random

import pytest

from skyquarry.operators import depressions as dp
from skyquarry.operators import terrain as te

STEPS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def grid(seed, w, h, kind):
    rng = random.Random(seed)
    z = {}
    for y in range(h):
        for x in range(w):
            z[x - 3, y - 2] = {"noise": rng.random() * 100, "steps": float(rng.randrange(4)), "bowl": math.hypot(x - w / 2, y - h / 2) - 30 + rng.random(), "flat": 1.0}[kind]
    for _ in range(int(w * h * 0.004)):
        z.pop((rng.randrange(w) - 3, rng.randrange(h) - 2), None)
    return z


def flood(z):
    """Level, steps and direction by one queue."""
    near = lambda c: [(k, (c[0] + sx, c[1] + sy)) for k, (sx, sy) in enumerate(STEPS)]
    label = {c: (z[c], 0) for c in z if sum(n in z for _, n in near(c)) < 8}
    todo = [(v, c) for c, v in label.items()]
    heapq.heapify(todo)
    while todo:
        v, c = heapq.heappop(todo)
        if v > label[c]:
            continue
        for _, n in near(c):
            if n in z:
                new = (z[n], 0) if z[n] > v[0] else (v[0], v[1] + 1)
                if n not in label or new < label[n]:
                    label[n] = new
                    heapq.heappush(todo, (new, n))
    out = {}
    for c in z:
        lower = [(label[n], z[n], k) for k, n in near(c) if n in z and label[n] < label[c]]
        out[c] = (label[c][0], min(lower)[2] if lower else -1, label[c])
    return out


def cut(z, tree):
    """Heights after breaching: parents after their children, deepest labels first."""
    least = {c: (v, v, 0) for c, v in z.items()}
    for c in sorted(z, key=lambda c: tree[c][2], reverse=True):
        k = tree[c][1]
        if k >= 0:
            n = (c[0] + STEPS[k][0], c[1] + STEPS[k][1])
            _, z0, far = least[c]
            least[n] = min(least[n], *[(z0 - dp.STEP * (far + 1), z0, far + 1)])
    return least


CASES = [(1, 23, 17, "noise", 5), (2, 40, 30, "steps", 8), (3, 33, 41, "bowl", 7), (4, 12, 9, "flat", 4), (5, 30, 30, "noise", 64)]


@pytest.mark.parametrize("seed,w,h,kind,tile", CASES)
def test_as_one_queue_does(spark, seed, w, h, kind, tile):
    z = grid(seed, w, h, kind)
    rows = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()] + [(100, 100, None)], "x bigint, y bigint, z double")
    tree, found = flood(z), {(r.x, r.y): r for r in dp.breached(rows, tile).collect()}
    assert set(found) == set(z)
    assert all((found[c].level, found[c].direction) == tree[c][:2] for c in z)
    low = cut(z, tree)
    assert max(abs(found[c].z - low[c][0]) for c in z) <= 4 * dp.STEP  # equal heights at other distances may differ by the step
    for c, r in found.items():
        assert r.z <= z[c]
        if r.direction >= 0:
            sx, sy = STEPS[r.direction]
            assert found[c[0] + sx, c[1] + sy].z < r.z


def test_no_inner_pits_are_left(spark):
    z = grid(7, 40, 35, "noise")
    rows = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "x bigint, y bigint, z double")
    inner = {c for c in z if all((c[0] + sx, c[1] + sy) in z for sx, sy in STEPS)}
    pits = lambda df: {(r.x, r.y) for r in te.d8_pointer(df).where("direction = -1").collect()} & inner
    assert pits(rows)
    assert not pits(dp.breached(rows, 9).select("x", "y", "z"))


def test_nothing_and_one_cell(spark):
    assert dp.breached(spark.createDataFrame([], "x bigint, y bigint, z double")).collect() == []
    one = dp.breached(spark.createDataFrame([(5, 5, 2.0)], "x bigint, y bigint, z double")).collect()
    assert [tuple(r) for r in one] == [(5, 5, 2.0, 2.0, -1)]


def test_levels_by_groups_of_tiles(spark, monkeypatch):
    """Four levels of groups, over tiles of three cells: every cell at a tile's border has its level."""
    monkeypatch.setattr(dp, "SIDE", 2)
    z = grid(9, 26, 22, "noise")
    rows = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "x bigint, y bigint, z double")
    edges = dp._spread(rows, 3).groupBy("tx", "ty").applyInPandas(dp._spills(3), "a bigint, b bigint, w double, tx bigint, ty bigint")
    levels, tree = {r.node: r.level for r in dp.spill_levels(dp.kept(edges), 3).collect()}, flood(z)
    assert set(levels) == {(y << 32) + x for x, y in z if x % 3 != 1 or y % 3 != 1}
    assert all(levels[(y << 32) + x] == tree[x, y][0] for x, y in z if (y << 32) + x in levels)
