"""Rasters in another reference system: a target grid, and the source's value at each of its pixels."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.engine.tables import kept
from skyquarry.operators.terrain import resampled

Transform = Callable[[Column, Column], tuple[Column, Column]]
#: Points of each edge of the source that the target's extent is taken from.
EDGE = 64


@dataclass(frozen=True)
class Grid:
    """A raster's place: the upper left corner of pixel (0, 0), the size of pixels (y downwards), and how many there are."""

    x: float
    y: float
    dx: float
    dy: float
    width: int
    height: int

    def place(self, col: Column, row: Column) -> tuple[Column, Column]:
        return col * self.dx + self.x, self.y - row * self.dy

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x - self.x) / self.dx, (self.y - y) / self.dy


def target_grid(spark: SparkSession, source: Grid, forward: Transform, pixel: float | None = None) -> Grid:
    """The grid that holds the source's outline in the target system.  pixel: its size; by default one that gives the diagonal as many pixels."""
    along = spark.range(EDGE + 1).select((F.col("id") / EDGE).alias("t"))
    w, h, t = float(source.width), float(source.height), F.col("t")
    outline = F.array(*(F.struct(c.alias("c"), r.alias("r")) for c, r in ((t * w, F.lit(0.0)), (t * w, F.lit(h)), (F.lit(0.0), t * h), (F.lit(w), t * h))))
    points = along.select(F.inline(outline))
    x, y = forward(*source.place(F.col("c"), F.col("r")))
    b = points.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    size = pixel or math.hypot(b["x1"] - b["x0"], b["y1"] - b["y0"]) / math.hypot(source.width, source.height)
    return Grid(b["x0"], b["y1"], size, size, max(1, math.ceil((b["x1"] - b["x0"]) / size - 1e-9)), max(1, math.ceil((b["y1"] - b["y0"]) / size - 1e-9)))


def source_positions(spark: SparkSession, source: Grid, target: Grid, backward: Transform, tolerance: float = 0.125, block: int = 64) -> DataFrame:
    """(x, y, sx, sy): for each target pixel's centre its place in the source's pixels, where that lies in the source.

    The transform is evaluated at the corners of blocks and interpolated between
    them; blocks whose middle or edge middles are off by more than ``tolerance``
    source pixels are quartered, down to single pixels.
    """
    across, down = -(-target.width // block), -(-target.height // block)
    at = lambda c, r: source.pixel(*backward(*target.place(c, r)))
    names = {(0.0, 0.0): "a", (1.0, 0.0): "b", (0.0, 1.0): "c", (1.0, 1.0): "d"}
    mixed = lambda u, v, i: (F.col(f"a{i}") * (1 - u) + F.col(f"b{i}") * u) * (1 - v) + (F.col(f"c{i}") * (1 - u) + F.col(f"d{i}") * u) * v

    def solved(blocks: DataFrame) -> DataFrame:
        left, top, size = F.col("left").cast("double"), F.col("top").cast("double"), F.col("size").cast("double")
        corners = {f"{n}{i}": p[i] for (u, v), n in names.items() for p in [at(left + size * u, top + size * v)] for i in (0, 1)}
        rows = blocks.withColumns(corners)
        off = []
        for u, v in ((0.5, 0.5), (0.5, 0.0), (0.5, 1.0), (0.0, 0.5), (1.0, 0.5)):
            exact = at(left + size * u, top + size * v)
            off += [F.abs(mixed(F.lit(u), F.lit(v), i) - exact[i]) for i in (0, 1)]
        return kept(rows.withColumn("off", F.greatest(*off)))

    rows = spark.range(across * down).select((F.col("id") % across * block).cast("bigint").alias("left"), (F.floor(F.col("id") / across) * block).alias("top"), F.lit(block).alias("size"))
    done = None
    while True:
        rows = solved(rows)
        fine = (F.coalesce(F.col("off"), F.lit(float("inf"))) <= tolerance) | (F.col("size") <= 1)
        good = rows.where(fine).drop("off")
        done = good if done is None else done.union(good)
        more = rows.where(~fine)
        if more.isEmpty():
            break
        half = (F.col("size") / 2).cast("int")
        quarter = F.array(*(F.struct((F.col("left") + half * i).alias("left"), (F.col("top") + half * j).alias("top"), half.alias("size")) for i in (0, 1) for j in (0, 1)))
        rows = more.select(F.inline(quarter))
    low = lambda c: F.least(*(F.col(f"{n}{c}") for n in "abcd"))
    high = lambda c: F.greatest(*(F.col(f"{n}{c}") for n in "abcd"))
    meets = (high(0) >= -1) & (low(0) <= source.width + 1) & (high(1) >= -1) & (low(1) <= source.height + 1)
    cells = done.where(meets).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    u, v = (F.col("i") + 0.5) / F.col("size"), (F.col("j") + 0.5) / F.col("size")
    cells = cells.select((F.col("left") + F.col("i")).alias("x"), (F.col("top") + F.col("j")).alias("y"), mixed(u, v, 0).alias("sx"), mixed(u, v, 1).alias("sy"))
    inside = (F.col("x") < target.width) & (F.col("y") < target.height) & (F.col("sx") >= 0) & (F.col("sx") < source.width) & (F.col("sy") >= 0) & (F.col("sy") < source.height)
    return cells.where(inside)


def reprojected(pixels: DataFrame, source: Grid, target: Grid, backward: Transform, method: str = "nearest", tolerance: float = 0.125, block: int = 64) -> DataFrame:
    """(x, y, z) of the target's pixels that lie in the source: nearest or bilinear (null beside a missing pixel).  block: a power of two."""
    if block < 1 or block & (block - 1):
        raise ValueError("a block's side must be a power of two")
    return resampled(pixels, source_positions(pixels.sparkSession, source, target, backward, tolerance, block), method).select("x", "y", "z")
