"""Point clouds: sampling by radius, as a maximal independent set found in rounds over small cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.engine.tables import kept
from skyquarry.operators.raster import inside_polygon

#: Two points of a cube of half the radius are always nearer than the radius, so a cube keeps one at most; what it can touch lies within two cubes.
_REACH = range(-2, 3)
_AROUND = [(i, j, k) for i in _REACH for j in _REACH for k in _REACH]


def sampled(points: DataFrame, radius: float) -> DataFrame:
    """The points of a sample in which no two are nearer than ``radius``, and from which every other is: points(x, y, z, ...).

    Points are taken in the order of a hash of their place; each is kept unless a kept
    one is nearer.  In a round a cube's first undecided point is kept if it comes
    before those of all cubes around; what is nearer to it goes.  That gives what
    taking them one by one would, in some log(n) rounds.  Nothing pairs the points of
    a cube: each cube sends its first, and a point meets the few kept around it.

    Of points at one place the least row stays (other columns compared in order).
    Nulls and nan in x, y or z leave a point out; no points give none.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    columns, others = points.columns, [c for c in points.columns if c not in ("x", "y", "z")]
    near = lambda c: F.floor(F.col(c).cast("double") / (radius / 2)).cast("bigint")
    whole = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in "xyz"))
    rest = F.min(F.struct(*others)) if others else F.lit(True)
    places = whole.groupBy("x", "y", "z").agg((rest if others else F.first(rest)).alias("_rest"))
    order = F.struct(F.xxhash64(*(F.col(c).cast("double") for c in "xyz")).alias("h"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    open_ = kept(places.select("x", "y", "z", "_rest", near("x").alias("cx"), near("y").alias("cy"), near("z").alias("cz"), order.alias("_o")))
    cube, out = ["cx", "cy", "cz"], None
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(s, "ijk", strict=True))) for s in _AROUND))
    spread = lambda df: df.withColumn("_s", F.explode(steps)).select(*((F.col(c) + F.col(f"_s.{i}")).alias(c) for c, i in zip(cube, "ijk", strict=True)), "_o", F.expr("_s.i = 0 AND _s.j = 0 AND _s.k = 0").alias("_own"))
    while not open_.isEmpty():
        first = open_.groupBy(*cube).agg(F.min("_o").alias("_o"))
        best = spread(first).groupBy(*cube).agg(F.min("_o").alias("_least"), F.min(F.when(F.col("_own"), F.col("_o"))).alias("_o"))
        won = kept(best.where(F.col("_o").isNotNull() & (F.col("_o") == F.col("_least"))).select(*cube, "_o"))
        hit = spread(won).groupBy(*cube).agg(F.collect_list(F.struct(*(F.col(f"_o.{c}").alias(c) for c in "xyz"))).alias("_kept"))  # as many as fit there
        away = lambda p: sum(((F.col(c).cast("double") - p[c]) * (F.col(c).cast("double") - p[c]) for c in "xyz"), F.lit(0.0)) < radius * radius
        chosen = open_.join(won.select("_o"), "_o", "left_semi").select("x", "y", "z", "_rest")
        out = kept(chosen if out is None else out.union(chosen), replaces=out)
        left = open_.join(hit, cube, "left").where(F.col("_kept").isNull() | ~F.exists("_kept", away)).drop("_kept")
        open_ = kept(left.select(open_.columns), replaces=[open_, won])
    if out is None:
        out = open_.select("x", "y", "z", "_rest")
    return out.select(*(F.col(c) if c in "xyz" else F.col(f"_rest.{c}").alias(c) for c in columns))


def translated(points: DataFrame, radius: float = 0.0, reproject: tuple[Column, Column] | None = None, ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """What an export does to a cloud, in its order: sampling by radius, other coordinates (expressions of x and y), a crop by a polygon in these."""
    out = sampled(points, radius) if radius > 0 else points
    if reproject is not None:
        out = out.withColumns({"x": reproject[0], "y": reproject[1]})
    return out if ring is None else out.where(inside_polygon(F.col("x"), F.col("y"), ring))
