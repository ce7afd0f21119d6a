"""Depressions of elevation grids: the level to which each would fill, and its breaching, over tiles.

The fill level of a cell is the least height that a path from it to the outside
must cross.  It is found without one queue over the raster: each tile is reduced to
the spill heights between the cells at its border (a spanning tree of the tile that
keeps these), groups of tiles are reduced in the same way to their common border,
level by level, levels are handed down again from the last group to the tiles, and
each tile then floods on its own from the border's levels.

Breaching drains each cell along one path, the tree of a flood that prefers, at one
level, the fewest steps; every cell on the path of a lower one is cut to just below
it.  Neither levels, tree nor cuts depend on the tiles.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.engine.tables import kept
from skyquarry.operators.terrain import NEIGHBOURS

#: The node that stands for all that lies outside.
OUTSIDE = -(1 << 63)
#: So many tiles, or groups of tiles, a side are a group of the next level.
SIDE = 16
#: What a cell on a breach lies below the one before it.
STEP = 2.0**-20
_STEPS = [(sy, sx) for sx, sy in NEIGHBOURS]


def node_of(x: Column, y: Column) -> Column:
    """A cell's number: y in the upper half, x in the lower."""
    return F.shiftleft(y.cast("bigint"), 32) + x.cast("bigint")


def _spread(cells: DataFrame, tile: int) -> DataFrame:
    """Each cell in its tile, and in those whose border it touches: (tx, ty) is added."""
    at = lambda c, step: F.floor((F.col(c) + step) / tile).cast("bigint")
    tiles = F.array_distinct(F.array(*(F.struct(at("x", i).alias("tx"), at("y", j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    return cells.withColumn("_t", F.explode(tiles)).select("_t.tx", "_t.ty", *cells.columns)


class _Block:
    """A tile with a margin of one cell, as arrays; nan is missing."""

    def __init__(self, pdf: pd.DataFrame, tile: int, *columns: str):
        self.tile, self.x0, self.y0 = tile, int(pdf["tx"].iloc[0]) * tile - 1, int(pdf["ty"].iloc[0]) * tile - 1
        side = tile + 2
        self.cols, self.rows = pdf["x"].to_numpy() - self.x0, pdf["y"].to_numpy() - self.y0
        self.of = {}
        for c in ("z", *columns):
            a = np.full((side, side), np.nan)
            a[self.rows, self.cols] = pdf[c].to_numpy(float)
            self.of[c] = a
        self.z = self.of["z"]
        self.there = ~np.isnan(self.z)
        self.own = np.zeros((side, side), bool)
        self.own[1:-1, 1:-1] = self.there[1:-1, 1:-1]
        around = sum(self.shifted(self.there, s, False).astype(int) for s in _STEPS)
        self.open = self.own & (around < 8)

    @staticmethod
    def shifted(a: np.ndarray, step: tuple[int, int], none):
        """a's value at the neighbour that lies a step away."""
        out = np.full_like(a, none)
        sy, sx = step
        h, w = a.shape
        out[max(0, -sy) : h - max(0, sy), max(0, -sx) : w - max(0, sx)] = a[max(0, sy) : h - max(0, -sy), max(0, sx) : w - max(0, -sx)]
        return out

    def border(self) -> np.ndarray:
        """The margin, and the tile's own outermost cells."""
        out = self.there.copy()
        out[2:-2, 2:-2] = False
        return out

    def frame(self, mask: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(mask)
        return pd.DataFrame({"x": c + self.x0, "y": r + self.y0, **{k: v[r, c] for k, v in values.items()}})


def _spills(tile: int):
    """(tx, ty, a, b, w): the spanning tree of a tile's border cells, and the outside, by the heights between them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf, tile)
        side = tile + 2
        z, open_ = block.z.ravel(), block.open.ravel()
        names = ((np.arange(side) + block.y0)[:, None] * (1 << 32) + (np.arange(side) + block.x0)).ravel()
        root = list(range(side * side + 1))  # the last is the outside
        stands = [None] * (side * side) + [OUTSIDE]
        for i in np.flatnonzero(block.border().ravel()).tolist():
            stands[i] = int(names[i])
        done = bytearray(side * side)
        edges: list[tuple[int, int, float]] = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def meet(i: int, j: int, w: float) -> None:
            i, j = find(i), find(j)
            if i != j:
                if stands[i] is not None and stands[j] is not None:
                    edges.append((stands[i], stands[j], w))
                root[j] = i
                stands[i] = stands[i] if stands[i] is not None else stands[j]

        at = np.flatnonzero(block.there.ravel())
        for i in at[np.argsort(z[at], kind="stable")].tolist():
            done[i] = 1
            r, c = divmod(i, side)
            for sy, sx in _STEPS:
                if 0 <= r + sy < side and 0 <= c + sx < side and done[j := i + sy * side + sx]:
                    meet(i, j, z[i])
            if open_[i]:
                meet(side * side, i, z[i])
        return _edge_frame(edges, pdf["tx"].iloc[0], pdf["ty"].iloc[0])

    return run


def _edge_frame(edges: list[tuple[int, int, float]], tx: int, ty: int) -> pd.DataFrame:
    out = pd.DataFrame(edges, columns=["a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "float64"})
    return out.assign(tx=int(tx), ty=int(ty))


class _Groups:
    """Groups of tiles that lie in a grid of ``size`` groups, ``side`` tiles each way, from tile ``low`` on to tile ``high``."""

    def __init__(self, tile: int, low: tuple[int, int], high: tuple[int, int], side: int):
        self.tile, self.low, self.high, self.side = tile, low, high, side

    def __len__(self) -> int:
        return math.prod((h - a) // self.side + 1 for a, h in zip(self.low, self.high, strict=True))

    def of(self, tx: Column, ty: Column) -> list[Column]:
        group = lambda t, k: F.floor((F.greatest(F.least(t, F.lit(self.high[k])), F.lit(self.low[k])) - self.low[k]) / self.side).cast("bigint")
        return [group(tx, 0).alias("gx"), group(ty, 1).alias("gy")]

    def around(self, node: Column) -> Column:
        """The groups of the tiles that a cell lies in or next to."""
        y = F.shiftright(node, 32)
        x = F.shiftright(F.shiftleft(node, 32), 32)
        at = lambda c, i: F.floor((c + i) / self.tile).cast("bigint")
        return F.array_distinct(F.array(*(F.struct(*self.of(at(x, i), at(y, j))) for i in (-1, 0, 1) for j in (-1, 0, 1))))

    def shared(self, node: np.ndarray) -> np.ndarray:
        """Whether a cell is known to several groups."""
        y = node >> 32
        several = np.zeros(len(node), bool)
        for k, c in enumerate((((node + (1 << 31)) & 0xFFFFFFFF) - (1 << 31), y)):
            group = [(np.clip((c + i) // self.tile, self.low[k], self.high[k]) - self.low[k]) // self.side for i in (-1, 1)]
            several |= group[0] != group[1]
        return several & (node != OUTSIDE)


def _joined(groups: _Groups):
    """(tx, ty, a, b, w): the spanning tree of the cells that a group shares with others, and the outside; tx, ty is a tile of the group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w", kind="stable")
        nodes, at = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
        stands = [n if keep else None for n, keep in zip(nodes.tolist(), (groups.shared(nodes) | (nodes == OUTSIDE)).tolist(), strict=True)]
        root, edges = list(range(len(nodes))), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (i, j), w in zip(at.reshape(-1, 2).tolist(), pdf["w"].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                if stands[i] is not None and stands[j] is not None:
                    edges.append((stands[i], stands[j], w))
                root[j] = i
                stands[i] = stands[i] if stands[i] is not None else stands[j]
        return _edge_frame(edges, pdf["tx"].iloc[0], pdf["ty"].iloc[0])

    return run


def _solved(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """(node, level) of a group's cells, from those that are known and the outside."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["w"].tolist(), strict=True):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    level = dict.fromkeys(near, math.inf)
    level |= {n: v for n, v in zip(known["node"].tolist(), known["level"].tolist(), strict=True) if n in near}
    if OUTSIDE in near:
        level[OUTSIDE] = -math.inf
    todo = [(v, n) for n, v in level.items() if v < math.inf]
    heapq.heapify(todo)
    while todo:
        v, n = heapq.heappop(todo)
        if v > level[n]:
            continue
        for m, w in near[n]:
            if level[m] > (u := max(v, w)):
                level[m] = u
                heapq.heappush(todo, (u, m))
    level.pop(OUTSIDE, None)
    return pd.DataFrame({"node": np.fromiter(level, np.int64, len(level)), "level": np.fromiter(level.values(), float, len(level))})


def spill_levels(edges: DataFrame, tile: int) -> DataFrame:
    """(node, level): for each node of edges(tx, ty, a, b, w) the least height that a path to OUTSIDE must cross.

    A group of SIDE by SIDE tiles is reduced to what it shares with others, groups
    of groups likewise, until one is left, which holds no more than the borders of
    SIDE * SIDE groups.  Its levels are handed down: a group's cells are solved from
    those that it shares and the outside.  So the jobs are twice the levels, which
    grow with the logarithm of the tiles, to the base SIDE.
    """
    found = edges.agg(*(f(c) for f in (F.min, F.max) for c in ("tx", "ty"))).first()
    if found[0] is None:
        return edges.sparkSession.createDataFrame([], "node bigint, level double")
    levels, now, side = [], edges, 1
    while True:
        side *= SIDE
        groups = _Groups(tile, tuple(found[:2]), tuple(found[2:]), side)
        levels.append((groups, now))
        if len(groups) == 1:
            break
        grouped = now.select("*", *groups.of(F.col("tx"), F.col("ty"))).groupBy("gx", "gy")
        now = kept(grouped.applyInPandas(_joined(groups), "a bigint, b bigint, w double, tx bigint, ty bigint"))
    known = edges.sparkSession.createDataFrame([], "node bigint, level double")
    for groups, now in reversed(levels):
        given = known.select("node", "level", F.explode(groups.around(F.col("node"))).alias("g")).select("node", "level", "g.gx", "g.gy")
        own = now.select("a", "b", "w", *groups.of(F.col("tx"), F.col("ty")))
        solved = own.groupBy("gx", "gy").cogroup(given.groupBy("gx", "gy")).applyInPandas(_solved, "node bigint, level double")
        known = kept(solved.groupBy("node").agg(F.min("level").alias("level")))
    return known


def _walk(block: _Block, level: np.ndarray, steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Steps within cells of one level from those at ``start``; only the tile's own cells change."""
    todo = [(steps[r, c], r, c) for r, c in zip(*np.nonzero(start & np.isfinite(steps)), strict=True)]
    heapq.heapify(todo)
    n = steps.shape[0]
    while todo:
        d, r, c = heapq.heappop(todo)
        if d > steps[r, c]:
            continue
        for sy, sx in _STEPS:
            i, j = r + sy, c + sx
            if 0 <= i < n and 0 <= j < n and block.own[i, j] and level[i, j] == level[r, c] and steps[i, j] > d + 1:
                steps[i, j] = d + 1
                heapq.heappush(todo, (d + 1, i, j))
    return steps


def _flooded(tile: int):
    """A tile's own cells with level, and steps as far as the tile alone can tell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf, tile, "known")
        level = np.where(block.open, block.z, block.of["known"])
        todo = [(level[r, c], r, c) for r, c in zip(*np.nonzero(~np.isnan(level)), strict=True)]
        level = np.where(np.isnan(level), np.inf, level)
        heapq.heapify(todo)
        n = tile + 2
        while todo:
            w, r, c = heapq.heappop(todo)
            if w > level[r, c]:
                continue
            for sy, sx in _STEPS:
                i, j = r + sy, c + sx
                if 0 <= i < n and 0 <= j < n and block.there[i, j] and level[i, j] > (v := max(w, block.z[i, j])):
                    level[i, j] = v
                    heapq.heappush(todo, (v, i, j))
        lowest = np.min([block.shifted(level, s, np.inf) for s in _STEPS], axis=0)
        leaves = block.own & (level == block.z) & (block.open | (lowest < level))
        steps = _walk(block, level, np.where(leaves, 0.0, np.inf), leaves)
        return block.frame(block.own, z=block.z, level=level, steps=steps).assign(tx=pdf["tx"].iloc[0], ty=pdf["ty"].iloc[0])

    return run


def _further(tile: int):
    """The own cells that the margin's steps bring nearer to the way out; those of the tile are settled among themselves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf, tile, "level", "steps")
        before = np.where(np.isnan(block.of["steps"]), np.inf, block.of["steps"])
        after = _walk(block, block.of["level"], before.copy(), ~block.own)
        return block.frame(block.own & (after < before), steps=after).assign(tx=pdf["tx"].iloc[0], ty=pdf["ty"].iloc[0])

    return run


def _drained(tile: int):
    """Each own cell's direction: the neighbour of least level, steps and height among those before it; -1 where water leaves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf, tile, "level", "steps")
        keys = [np.where(block.there, block.of[c], np.inf) for c in ("level", "steps", "z")]
        shape = block.z.shape
        best, direction = [np.full(shape, np.inf) for _ in keys], np.full(shape, -1)
        for k, s in enumerate(_STEPS):
            near = [block.shifted(a, s, np.inf) for a in keys]
            before = (near[0] < keys[0]) | ((near[0] == keys[0]) & (near[1] < keys[1]))
            less, same = np.zeros(shape, bool), np.ones(shape, bool)
            for a, b in zip(near, best, strict=True):
                less |= same & (a < b)
                same &= a == b
            take = before & less
            direction[take] = k
            best = [np.where(take, a, b) for a, b in zip(near, best, strict=True)]
        return block.frame(block.own, z=block.z, level=keys[0], direction=direction)

    return run


def drained(dem: DataFrame, tile: int = 256) -> DataFrame:
    """(x, y, z, level, direction): the fill level, and the neighbour (number in NEIGHBOURS) towards the outside, -1 where water leaves.

    Cells without a value are missing; those next to a missing cell, or at the edge,
    are where water leaves.  A cell occurs once.  At most a tile is in one task;
    tiles exchange their borders only.
    """
    cells = dem.where("z IS NOT NULL AND NOT isnan(z)").select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.col("z").cast("double").alias("z"))
    inside = lambda df: df.groupBy("tx", "ty")
    edges = kept(inside(_spread(cells, tile)).applyInPandas(_spills(tile), "a bigint, b bigint, w double, tx bigint, ty bigint"))
    levels = spill_levels(edges, tile).withColumnRenamed("level", "known")
    named = cells.withColumn("node", node_of(F.col("x"), F.col("y"))).join(levels, "node", "left").drop("node")
    own = "x bigint, y bigint, z double, level double, steps double, tx bigint, ty bigint"
    now = kept(inside(_spread(named, tile)).applyInPandas(_flooded(tile), own))
    spread = lambda df: _spread(df.select("x", "y", "z", "level", "steps"), tile)
    edge = (F.pmod("x", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("y", F.lit(tile)).isin(0, tile - 1))
    changed, better = now.where(edge & (F.col("steps") < float("inf"))).select("x", "y", "tx", "ty"), []

    def latest(rows: DataFrame) -> DataFrame:
        if not better:
            return rows
        least = reduce(DataFrame.union, better).groupBy("x", "y").agg(F.min("steps").alias("less"))
        return rows.join(least, ["x", "y"], "left").withColumn("steps", F.least("steps", "less")).drop("less")

    while not changed.isEmpty():  # as often as the way out of one level crosses from tile to tile; a round reads the tiles that it may change, and what lies next to them
        active = kept(_spread(changed.withColumnsRenamed({"tx": "ox", "ty": "oy"}), tile).where("tx <> ox OR ty <> oy").select("tx", "ty").distinct())
        beside = active.select(F.explode(F.array(*(F.struct((F.col("tx") + i).alias("tx"), (F.col("ty") + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("t")).select("t.*").distinct()
        rows = spread(latest(now.join(beside, ["tx", "ty"], "left_semi"))).join(active, ["tx", "ty"], "left_semi")
        again = kept(inside(rows).applyInPandas(_further(tile), "x bigint, y bigint, steps double, tx bigint, ty bigint"))
        better.append(again.select("x", "y", "steps"))
        changed = again.where(edge).select("x", "y", "tx", "ty")
    now = latest(now)
    return inside(spread(now)).applyInPandas(_drained(tile), "x bigint, y bigint, z double, level double, direction int")


def breached(dem: DataFrame, tile: int = 256, step: float = STEP) -> DataFrame:
    """(x, y, z, level, direction), z being cut so that each cell but the outlets lies above the one it drains to.

    A cell's new height is the least, over itself and all that drain through it, of
    their height less ``step`` for each cell between.  Found by pointer doubling:
    after k rounds all within 2**k cells have been seen; cells that have reached
    their outlet are set aside.  What a round brings is written once, and all rounds
    are put together at the end.
    """
    tree = kept(drained(dem, tile))
    go = lambda k: F.element_at(F.array(*(F.lit(n[k]) for n in NEIGHBOURS)), F.col("direction") + 1)
    value = F.struct(F.col("z").alias("v"), F.col("z").alias("z0"), F.lit(0).cast("bigint").alias("far"))
    moving = kept(tree.where("direction >= 0").select("x", "y", (F.col("x") + go(0)).alias("tx"), (F.col("y") + go(1)).alias("ty"), value.alias("low")))
    least, jump = [tree.select("x", "y", value.alias("low"))], 1
    while not moving.isEmpty():
        far = F.col("low.far") + jump
        given = kept(moving.select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.struct((F.col("low.z0") - F.lit(step) * far).alias("v"), F.col("low.z0").alias("z0"), far.alias("far")).alias("low")).groupBy("x", "y").agg(F.min("low").alias("low")))
        least.append(given)
        ahead = moving.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("tx").alias("nx"), F.col("ty").alias("ny"))
        on = moving.join(ahead, ["tx", "ty"]).select("x", "y", F.col("nx").alias("tx"), F.col("ny").alias("ty"), "low")
        on = on.join(given.withColumnRenamed("low", "more"), ["x", "y"], "left").select("x", "y", "tx", "ty", F.least("low", "more").alias("low"))
        moving, jump = kept(on, replaces=moving), jump * 2
    lowest = reduce(DataFrame.union, least).groupBy("x", "y").agg(F.min("low").alias("low"))
    return tree.drop("z").join(lowest.select("x", "y", F.col("low.v").alias("z")), ["x", "y"]).select("x", "y", "z", "level", "direction")
