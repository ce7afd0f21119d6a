"""Pixels of many polygons at once: crops and volumes for a table of rings, by scanline spans.

A polygon becomes (id, y, from, to) intervals of its pixels in each row; these are
joined to pixels by row and block of columns, so polygons and pixels meet by an
equi-join however many of either there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.functions.ieee import half_away
from skyquarry.operators.terrain import triangulate

#: Columns of pixels that a join key holds.
BLOCK = 32
#: Spans of one key that are joined in one task.
SPANS = 1 << 14
SPAN = "array<struct<a:bigint,b:bigint>>"


def edges(polygons: DataFrame) -> DataFrame:
    """polygons' other columns and ax, ay, bx, by: one row an edge of ``ring`` (structs x, y; closed or not)."""
    n, at = F.size("ring"), lambda i: F.element_at("ring", i)
    rows = polygons.where(F.col("ring").isNotNull() & (n >= 3)).withColumn("_i", F.explode(F.sequence(F.lit(1), n)))
    number = lambda i, c: at(i)[c].cast("double")
    here, after = F.col("_i"), F.col("_i") % n + 1
    return rows.select(*[c for c in polygons.columns if c != "ring"], number(here, "x").alias("ax"), number(here, "y").alias("ay"), number(after, "x").alias("bx"), number(after, "y").alias("by"))


def _rows(first: Column, last: Column) -> Column:
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))


def _merged(spans: Column) -> Column:
    """Sorted spans without overlaps."""
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), lambda acc, s: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["b"] < s["a"] - 1), F.concat(acc, F.array(s))).otherwise(grown(acc, s)))


def spans(polygons: DataFrame, rule: str = "centre") -> DataFrame:
    """(id, y, a, b) of polygons(id, ring), pixels a to b of row y: disjoint, and in order within a row.

    centre: the pixel's centre lies inside (even-odd rule; a left or upper edge counts
    as inside).  touched: also every pixel whose closed square an edge meets.  Null
    rings and those of fewer than three corners have no pixels; rows that repeat an
    id add up as one even-odd figure, so holes are rings of the same id.
    """
    if rule not in ("centre", "touched"):
        raise ValueError(f"unknown rule {rule!r}")
    sides = edges(polygons.select("id", "ring"))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    middle = F.col("y") + 0.5
    crossing = sides.where("ay <> by").withColumn("y", _rows(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1))
    crossing = crossing.select("id", "y", ((middle - F.col("ay")) * ((F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))) + F.col("ax")).alias("at"))
    inside = crossing.groupBy("id", "y").agg(F.array_sort(F.collect_list("at")).alias("ats"))  # as many as edges cross the row
    pair = lambda i: F.struct(F.ceil(F.element_at("ats", 2 * i - 1) - 0.5).alias("a"), (F.ceil(F.element_at("ats", 2 * i) - 0.5) - 1).alias("b"))
    inside = inside.select("id", "y", F.explode(F.filter(F.transform(F.sequence(F.lit(1), (F.size("ats") / 2).cast("int")), pair), lambda s: s["a"] <= s["b"])).alias("s"))
    if rule == "touched":
        met = sides.withColumn("y", _rows(F.ceil(low) - 1, F.floor(high)))
        at = lambda v: F.when(F.col("ay") == F.col("by"), None).otherwise(F.col("ax") + (v - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)))
        one, two = F.coalesce(at(F.greatest(low, F.col("y").cast("double"))), F.col("ax")), F.coalesce(at(F.least(high, F.col("y") + 1.0)), F.col("bx"))
        met = met.select("id", "y", F.struct((F.ceil(F.least(one, two)) - 1).alias("a"), F.floor(F.greatest(one, two)).alias("b")).alias("s"))
        inside = inside.union(met)
    merged = inside.groupBy("id", "y").agg(_merged(F.collect_list("s")).alias("s"))
    return merged.select("id", "y", F.inline("s"))


def in_polygons(pixels: DataFrame, polygons: DataFrame, rule: str = "centre") -> DataFrame:
    """id and the pixel's columns, for every pixel of every polygon: the crop of each.  A pixel in several polygons occurs once for each.

    Where many polygons lie on one place, its spans are dealt over tasks, SPANS a task, and its pixels go to each.
    """
    found = spans(polygons, rule).withColumnRenamed("y", "_y")
    found = found.withColumn("_block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor(F.col("b") / BLOCK))))
    many = found.groupBy(F.col("_y").alias("_my"), F.col("_block").alias("_mb")).agg(F.ceil(F.count(F.lit(1)) / SPANS).alias("_tasks")).where("_tasks > 1")
    many = F.broadcast(many)  # a row for SPANS spans at most
    found = found.join(many, (F.col("_y") == F.col("_my")) & (F.col("_block") == F.col("_mb")), "left")
    found = found.select("id", "_y", "a", "b", F.col("_block").alias("_fb"), F.pmod(F.xxhash64("id", "a"), F.coalesce("_tasks", F.lit(1))).alias("_fd"))
    rows = pixels.withColumn("_block", F.floor(F.col("x") / BLOCK))
    rows = rows.join(many, (F.col("y") == F.col("_my")) & (F.col("_block") == F.col("_mb")), "left")
    rows = rows.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_tasks", F.lit(1)) - 1)))
    # by a shuffle: a broadcast would leave a place's matches to the task that reads its pixels
    met = rows.join(found.hint("merge"), (F.col("y") == F.col("_y")) & (F.col("_block") == F.col("_fb")) & (F.col("_deal") == F.col("_fd")) & F.col("x").between(F.col("a"), F.col("b")))
    return met.select("id", *(F.col(c) for c in pixels.columns))


def _triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The polygons' triangles, each as its corners' coordinates and heights."""
    for b in batches:
        out = []
        for at in b["corners"]:
            known = [(c["x"], c["y"], c["z"]) for c in at if c["z"] is not None and not math.isnan(c["z"])]
            out.append([[v for i in t for v in known[i]] for t in triangulate([p[:2] for p in known])])
        yield pd.DataFrame({"id": b["id"], "base": out})


def bases(dem: DataFrame, polygons: DataFrame, method: str, custom: float | None = None) -> DataFrame:
    """(id, base) of polygons(id, ring), from the heights of their corners' pixels; corners without a value are left out.

    base is m1, m2, b of a plane over x and y, or (triangulate) the triangles.  It is
    null where a corner lies outside the raster or where no plane is determined.
    """
    if method == "custom":
        if custom is None:
            raise ValueError("a custom base needs its elevation")
        return polygons.select("id", F.array(F.lit(0.0), F.lit(0.0), F.lit(float(custom))).alias("base"))
    if method not in ("average", "highest", "lowest", "plane", "triangulate"):
        raise ValueError(f"unknown base {method!r}")
    corners = polygons.where(F.size("ring") >= 3).select("id", F.posexplode("ring").alias("i", "c")).select("id", "i", F.floor("c.x").alias("cx"), F.floor("c.y").alias("cy"))
    heights = dem.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").cast("double").alias("z"), F.lit(True).alias("there"))
    at = corners.join(heights, ["cx", "cy"], "left").select("id", "i", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), "z", "there")
    whole = F.count("there") == F.count(F.lit(1))
    if method == "triangulate":
        listed = at.groupBy("id").agg(F.when(whole, F.array_sort(F.collect_list(F.struct("i", "x", "y", "z")))).alias("corners")).where("corners IS NOT NULL")
        return listed.mapInPandas(_triangles, "id bigint, base array<array<double>>" if dict(polygons.dtypes)["id"] == "bigint" else f"id {dict(polygons.dtypes)['id']}, base array<array<double>>")
    if method != "plane":
        value = {"average": F.avg, "highest": F.max, "lowest": F.min}[method]("z")
        return at.groupBy("id").agg(F.when(whole, F.array(F.lit(0.0), F.lit(0.0), value)).alias("base"))
    known = lambda c: F.when(F.col("z").isNotNull(), F.col(c))
    co = lambda a, b: F.covar_pop(known(a), known(b))
    fit = at.groupBy("id").agg(whole.alias("whole"), *(F.avg(known(c)).alias(f"m{c}") for c in "xyz"), co("x", "x").alias("xx"), co("y", "y").alias("yy"), co("x", "y").alias("xy"), co("x", "z").alias("xz"), co("y", "z").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    fit = fit.where("whole").withColumn("det", F.when(det > 1e-12, det))
    fit = fit.withColumn("m1", (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.col("det")).withColumn("m2", (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.col("det"))
    return fit.select("id", F.when(F.col("det").isNotNull(), F.array("m1", "m2", F.col("mz") - F.col("m1") * F.col("mx") - F.col("m2") * F.col("my"))).alias("base"))


def base_at(method: str) -> Column:
    """The base's height at x, y."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    if method != "triangulate":
        return F.col("base")[0] * x + F.col("base")[1] * y + F.col("base")[2]

    def inside(t: Column) -> Column:
        x0, y0, z0, x1, y1, z1, x2, y2, z2 = (t[i] for i in range(9))
        d = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)
        u, v = (x - x2) * ((y1 - y2) / d) + (y - y2) * ((x2 - x1) / d), (x - x2) * ((y2 - y0) / d) + (y - y2) * ((x0 - x2) / d)
        w = 1.0 - u - v
        return F.when(F.least(u, v, w) >= -1e-9, u * z0 + v * z1 + w * z2)

    return F.try_element_at(F.filter(F.transform("base", inside), lambda h: h.isNotNull()), F.lit(1))


def volumes(dem: DataFrame, polygons: DataFrame, method: str, custom: float | None = None, pixel_area: float = 1.0, metres: float = 1.0, digits: int = 4) -> DataFrame:
    """(id, n, volume) for each polygon: touched pixels with a value, and the absolute net volume between surface and base.

    One row an id; where no pixel has a value, or there is no base, the volume is
    null.  methods: average, highest, lowest, custom, plane, triangulate.
    """
    within = in_polygons(dem.select("x", "y", F.col("z").cast("double").alias("z")), polygons, "touched")
    based = within.join(bases(dem, polygons, method, custom).where("base IS NOT NULL").dropDuplicates(["id"]), "id", "left")
    sums = based.groupBy("id").agg(F.count("z").alias("n"), F.abs(half_away(F.sum(F.col("z") - base_at(method)) * (pixel_area * metres**3), digits)).alias("volume"))
    return polygons.select("id").distinct().join(sums, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "volume")
