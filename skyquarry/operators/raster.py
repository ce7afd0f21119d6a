"""Statistics, rescaling, colours, windows and crops of pixel relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyquarry.functions.ieee import divide


def valid(v: Column, alpha: Column | None = None, nodata: float | None = None) -> Column:
    """The value where it is a pixel's: alpha isn't 0 and it isn't nodata; else null."""
    keep = F.lit(True)
    if alpha is not None:
        keep = keep & (alpha != 0)
    if nodata is not None:
        keep = keep & (v != F.lit(nodata))
    return F.when(keep, v)


#: Relative error of the sketches that bracket a percentile.
SKETCH = 1e-4


def percentiles(pixels: DataFrame, value: str, by: list[str], shares: list[float], more: dict[str, Column] | None = None) -> DataFrame:
    """by and ``p``: the exact, interpolated percentiles of each group's non-null values, in memory that doesn't grow with it.

    more: further aggregates of the value ``_v``, taken in the sketch's scan.

    A mergeable sketch brackets each percentile; a second scan counts what lies
    below the bracket and the values inside, a few in ten thousand, by value; these
    are ranked in order.  The brackets, one row a group, go to every executor: a
    few large groups would else be whole in a task each.
    """
    v = F.col(value)
    rows = pixels.where(v.isNotNull()).select(*by, v.cast("double").alias("_v"))
    near = [F.lit(min(1.0, max(0.0, p + e))) for p in shares for e in (-5 * SKETCH, 5 * SKETCH)]
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*near), int(1 / SKETCH)).alias("_q"), *(c.alias(n) for n, c in (more or {}).items()))
    also = ["_n", *(more or {})]  # one value a group, carried along
    first = [F.first(n).alias(n) for n in more or {}]
    joined = rows.join(F.broadcast(ends), by) if by else rows.crossJoin(ends)  # one row
    one = lambda i: F.when(F.col("_v") <= F.col("_q")[2 * i + 1], F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= F.col("_q")[2 * i], F.col("_v")).alias("v")))
    seen = joined.select(*by, *also, F.explode(F.array_compact(F.array(*(one(i) for i in range(len(shares)))))).alias("_x"))
    seen = seen.groupBy(*by, *also, F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("_upto", F.sum("_c").over(order))
    place = F.element_at(F.array(*(F.lit(float(p)) for p in shares)), F.col("_i") + 1) * (F.col("_n") - 1)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    ranked = seen.withColumn("_k", place).groupBy(*by, "_i").agg(*first, F.first("_k").alias("_k"), at(F.floor("_k")).alias("_lo"), at(F.ceil("_k")).alias("_hi"))
    lo, hi, k = F.col("_lo"), F.col("_hi"), F.col("_k")
    exact = F.when(lo == hi, lo).otherwise((F.ceil(k) - k) * lo + (k - F.floor(k)) * hi)
    found = ranked.select(*by, *(more or {}), "_i", exact.alias("_p")).groupBy(*by).agg(*first, F.sort_array(F.collect_list(F.struct("_i", "_p"))).alias("_l"))
    return found.select(*by, *(more or {}), F.transform("_l", lambda x: x["_p"]).alias("p"))


def statistics(pixels: DataFrame, value: str, by: list[str], limits: tuple[float, float] | None = None, factor: float = 1.0) -> DataFrame:
    """min, max, std, p2, p98 and count of the non-null values of each group.

    ``limits`` replaces min and max by an index's range and clamps the
    percentiles to it; ``factor`` scales every result (units).  Percentiles are
    exact (interpolated), over all pixels.
    """
    v = F.col("_v")
    out = percentiles(pixels, value, by, [0.02, 0.98], {"n": F.count(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v)})
    out = out if by else out.withColumn("n", F.coalesce("n", F.lit(0)))
    lo, hi, p2, p98 = F.col("min"), F.col("max"), F.col("p")[0], F.col("p")[1]
    if limits is not None:
        lo, hi = F.lit(limits[0]), F.lit(limits[1])
        p2, p98 = F.greatest(p2, lo), F.least(p98, hi)
    k = F.lit(float(factor))
    return out.select(*by, "n", (lo * k).alias("min"), (hi * k).alias("max"), (F.col("std") * k).alias("std"), (p2 * k).alias("p2"), (p98 * k).alias("p98"))


def histogram(pixels: DataFrame, value: str, by: list[str], bins: int = 255, limits: tuple[float, float] | None = None) -> DataFrame:
    """(group, bin from 0, count): equal bins, the last closed on the right; values outside the limits are left out.

    Without limits each group's own minimum and maximum count; where they are
    equal the range is widened by a half on either side.
    """
    v = F.col(value)
    if limits is not None:
        rows = pixels.select(*by, v.alias("v"), F.lit(float(limits[0])).alias("lo"), F.lit(float(limits[1])).alias("hi"))
    else:
        ends = pixels.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        flat = F.col("lo") == F.col("hi")
        ends = ends.select(*by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
        rows = pixels.select(*by, v.alias("v")).join(ends, by) if by else pixels.select(v.alias("v")).crossJoin(ends)  # one row
    rows = rows.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    at = F.least(F.floor((F.col("v") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return rows.groupBy(*by, at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def accepted_range(asked: tuple[float, float] | None, own: tuple[float, float] | None) -> tuple[float, float] | None:
    """The asked range if it lies inside the index's own; else that."""
    if asked and own and own[0] <= asked[0] < asked[1] <= own[1]:
        return asked
    return own


def rescale(v: Column, lo: float | Column, hi: float | Column) -> Column:
    """[lo, hi] to [0, 255], clipped."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(v.isNotNull(), divide((F.greatest(F.least(v, hi), lo) - lo) * F.lit(255.0), hi - lo))


def to_byte(v: Column) -> Column:
    """Truncated to 0..255."""
    return F.when(v.isNotNull(), F.floor(F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0))).cast("int"))


def on_white(v: Column, mask: Column) -> Column:
    return F.when(mask == 0, F.lit(255)).otherwise(v)


def stretched(pixels: DataFrame, value: str) -> DataFrame:
    """The value mapped from its overall minimum and maximum to 0..255; a constant becomes 128. One row is joined to all."""
    ends = pixels.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    out = F.when(lo == hi, F.lit(128.0)).otherwise((F.col(value) - lo) * F.lit(255.0) / (hi - lo))
    return pixels.crossJoin(F.broadcast(ends)).withColumn("stretched", out).drop("_lo", "_hi")


def subwindows(spark: SparkSession, width: int, height: int, most: int, overlap: int = 0) -> DataFrame:
    """Windows (x, y, w, h) of at most ``most`` pixels a side that cover a raster; the last of a row or column is moved back to end at the edge."""

    def cuts(n: int, name: str) -> DataFrame:
        step = max(1, most - overlap)
        starts = spark.range(0, max(1, -(-max(n - overlap, 1) // step))).select((F.col("id") * step).alias("s"))
        at = F.greatest(F.least(F.col("s"), F.lit(n - most)), F.lit(0))
        return starts.select(at.alias(name), F.lit(min(most, n)).cast("bigint").alias(f"{name}_size")).distinct()

    grid = cuts(width, "x").crossJoin(cuts(height, "y"))  # a row for each window: that is the result
    return grid.select("x", "y", F.col("x_size").alias("w"), F.col("y_size").alias("h"))


def padded(x: Column, y: Column, w: Column, h: Column, pad: int) -> tuple[Column, Column, Column, Column]:
    return x - pad, y - pad, w + 2 * pad, h + 2 * pad


def block_key(x: Column, y: Column, size: int) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


def read_window(pixels: DataFrame, x0: int, y0: int, w: int, h: int, fill: float | None = None) -> DataFrame:
    """The window's pixels; with ``fill``, places outside the raster too, with that value."""
    inside = pixels.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    if fill is None:
        return inside
    xs = pixels.sparkSession.range(x0, x0 + w).select(F.col("id").alias("x"))
    ys = pixels.sparkSession.range(y0, y0 + h).select(F.col("id").alias("y"))
    return xs.crossJoin(ys).join(inside, ["x", "y"], "left").withColumn("z", F.coalesce("z", F.lit(float(fill))))


def preview(pixels: DataFrame, step: int) -> DataFrame:
    """Every step-th pixel of every step-th row: a sample by place, as a preview wants it."""
    return pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0))


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """Longitude and latitude bounds of a map tile."""
    import math

    n = 2.0**z
    lat = lambda t: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * t / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def zoom_window(lo: int, hi: int) -> tuple[int, int]:
    """Zooms that tiles are served at: three beyond either end."""
    return lo - 3, hi + 3


def tile_zoom(z: int, size: int) -> int:
    """Tiles of 512 pixels are one zoom level up; other sizes than 256 and 512 are errors."""
    if size not in (256, 512):
        raise ValueError("tiles are 256 or 512 pixels wide")
    return z - (size == 512)


def tile_zoom_of(z: Column, size: Column) -> Column:
    """tile_zoom as a Column; null for other sizes."""
    return F.when(size == 256, z).when(size == 512, z - 1)


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Is the point inside the ring (even-odd rule)? The bounding box is tested first, so scans can skip files and pages."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    odd = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 == y1:
            continue
        crosses = (F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)
        at = (y - F.lit(float(y0))) * F.lit((x1 - x0) / (y1 - y0)) + F.lit(float(x0))
        odd = odd + F.when(crosses & (x < at), 1).otherwise(0)
    return box & (odd % 2 == 1)


def all_opaque(mask: Column) -> Column:
    """Aggregate: is every pixel opaque?"""
    return F.bool_and(mask == 255)
