"""Queries on pixel relations: indices, statistics, colours, windows, terrain inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquarry.functions import color, units
from skyquarry.functions.ieee import rounded
from skyquarry.operators import formulas, raster
from skyquarry.plans.registry import query

#: The same indices as SQL text, written down apart from the operators so that one checks the other.
INDEX_SQL = {
    "NDVI": "(n - r) / (n + r)",
    "NDYI": "(g - b) / (g + b)",
    "NDRE": "(n - re) / (n + re)",
    "NDWI": "(g - n) / (g + n)",
    "NDVI (Blue)": "(n - b) / (n + b)",
    "ENDVI": "((n + g) - 2::DOUBLE * b) / ((n + g) + 2::DOUBLE * b)",
    "vNDVI": "0.5268::DOUBLE * (pow(r, -0.1294::DOUBLE) * pow(g, 0.3389::DOUBLE) * pow(b, -0.3118::DOUBLE))",
    "VARI": "(g - r) / (g + r - b)",
    "MPRI": "(g - r) / (g + r)",
    "EXG": "2::DOUBLE * g - (r + b)",
    "BAI": "1::DOUBLE / ((0.1::DOUBLE - r) * (0.1::DOUBLE - r) + (0.06::DOUBLE - n) * (0.06::DOUBLE - n))",
    "GLI": "(2::DOUBLE * g - r - b) / (2::DOUBLE * g + r + b)",
    "GNDVI": "(n - g) / (n + g)",
    "GRVI": "n / g",
    "SAVI": "1.5::DOUBLE * (n - r) / (n + r + 0.5::DOUBLE)",
    "MNLI": "(n * n - r) * 1.5::DOUBLE / (n * n + r + 0.5::DOUBLE)",
    "MSR": "(n / r - 1::DOUBLE) / (sqrt(n / r) + 1::DOUBLE)",
    "RDVI": "(n - r) / sqrt(n + r)",
    "TDVI": "1.5::DOUBLE * (n - r) / sqrt(n * n + r + 0.5::DOUBLE)",
    "OSAVI": "(n - r) / (n + r + 0.16::DOUBLE)",
    "LAI": "3.618::DOUBLE * (2.5::DOUBLE * ((n - r) / (n + 6::DOUBLE * r - 7.5::DOUBLE * b + 1::DOUBLE))) - 0.118::DOUBLE",
    "EVI": "2.5::DOUBLE * ((n - r) / (n + 6::DOUBLE * r - 7.5::DOUBLE * b + 1::DOUBLE))",
    "ARVI": "(n - 2::DOUBLE * r + b) / (n + 2::DOUBLE * r + b)",
    "Celsius": "l",
    "Kelvin": "l * 100::DOUBLE + 27315::DOUBLE",
    "_TESTRB": "r + b",
    "_TESTFUNC": "r + sqrt(b)",
}
CLEAN_SQL = "CASE WHEN isnan(v) THEN 0::DOUBLE WHEN abs(v) > 1e30 THEN -9999::DOUBLE ELSE v END"


def _bands(*names):
    return {b: F.col(b.lower()) for b in names}


def _index_query(name, number):
    key = f"x{number:02d}_{name.strip('_').lower().replace(' ', '_').replace('(', '').replace(')', '')}"
    sql = f"""
      WITH v AS (SELECT raster, {INDEX_SQL[name]} AS v FROM ortho WHERE alpha <> 0), c AS (SELECT raster, {CLEAN_SQL} AS v FROM v)
      SELECT raster, count(*) AS n, count(*) FILTER (v = -9999) AS n_nodata, count(*) FILTER (v = 0) AS n_zero,
             round(min(v), 6) + 0.0::DOUBLE AS lo, round(max(v), 6) + 0.0::DOUBLE AS hi, round(avg(v), 4) + 0.0::DOUBLE AS mean
      FROM c GROUP BY raster"""

    @query(key, sql)
    def run(t):
        v = formulas.index(name, _bands(*formulas.FORMULAS[name].bands))
        v0 = F.col("v")
        rows = t.ortho.where("alpha <> 0").select("raster", v.alias("v"))
        return rows.groupBy("raster").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(v0 == -9999).alias("n_nodata"),
            F.count_if(v0 == 0).alias("n_zero"),
            rounded(F.min(v0)).alias("lo"),
            rounded(F.max(v0)).alias("hi"),
            rounded(F.avg(v0), 4).alias("mean"),
        )


for _i, _name in enumerate(formulas.FORMULAS, 1):
    _index_query(_name, _i)

NDVI_PIXELS = f"""
  p AS (SELECT raster, {CLEAN_SQL} AS v FROM (SELECT raster, (n - r) / (n + r) AS v FROM ortho WHERE alpha <> 0))"""


def _ndvi(t):
    return t.ortho.where("alpha <> 0").select("raster", formulas.index("NDVI", _bands("N", "R")).alias("v"))


@query(
    "r18_ndvi_stats",
    f"""WITH {NDVI_PIXELS}
    SELECT raster, count(*) AS n, round(-1::DOUBLE, 6) AS min, 1::DOUBLE AS max, round(stddev_pop(v), 6) AS std,
           round(greatest(quantile_cont(v, 0.02), -1), 6) + 0.0::DOUBLE AS p2, round(least(quantile_cont(v, 0.98), 1), 6) + 0.0::DOUBLE AS p98
    FROM p GROUP BY raster""",
)
def _(t):
    out = raster.statistics(_ndvi(t), "v", ["raster"], limits=formulas.FORMULAS["NDVI"].range)
    return out.select("raster", "n", *(rounded(F.col(c)).alias(c) for c in ("min", "max", "std", "p2", "p98")))


@query("a08_min_max_std", "SELECT raster, round(min(g), 6) AS lo, round(max(g), 6) AS hi, round(stddev_pop(g), 6) AS std FROM ortho WHERE alpha <> 0 GROUP BY raster")
def _(t):
    g = F.col("g")
    return t.ortho.where("alpha <> 0").groupBy("raster").agg(rounded(F.min(g)).alias("lo"), rounded(F.max(g)).alias("hi"), rounded(F.stddev_pop(g)).alias("std"))


@query("a09_percentiles", "SELECT raster, round(quantile_cont(b, 0.02), 6) AS p2, round(quantile_cont(b, 0.98), 6) AS p98 FROM ortho WHERE alpha <> 0 GROUP BY raster")
def _(t):
    return raster.percentiles(t.ortho.where("alpha <> 0"), "b", ["raster"], [0.02, 0.98]).select("raster", rounded(F.col("p")[0]).alias("p2"), rounded(F.col("p")[1]).alias("p98"))


@query(
    "a10_histogram",
    f"""WITH {NDVI_PIXELS}, e AS (SELECT raster, min(v) AS lo, max(v) AS hi FROM p GROUP BY raster)
    SELECT raster, CAST(least(floor((v - lo) * 255 / (hi - lo)), 254) AS BIGINT) AS bin, count(*) AS n
    FROM p JOIN e USING (raster) GROUP BY 1, 2""",
)
def _(t):
    return raster.histogram(_ndvi(t), "v", ["raster"])


@query(
    "a10_histogram_range",
    f"""WITH {NDVI_PIXELS}
    SELECT raster, CAST(least(floor((v + 0.5) * 255 / 1.0::DOUBLE), 254) AS BIGINT) AS bin, count(*) AS n
    FROM p WHERE v BETWEEN -0.5 AND 0.5 GROUP BY 1, 2""",
)
def _(t):
    limits = raster.accepted_range((-0.5, 0.5), formulas.FORMULAS["NDVI"].range)
    return raster.histogram(_ndvi(t), "v", ["raster"], limits=limits)


@query(
    "a11_clamped_percentiles",
    f"""WITH {NDVI_PIXELS}
    SELECT raster, round(greatest(quantile_cont(v, 0.02), -0.3), 6) + 0.0::DOUBLE AS p2, round(least(quantile_cont(v, 0.98), 0.3), 6) + 0.0::DOUBLE AS p98 FROM p GROUP BY raster""",
)
def _(t):
    out = raster.statistics(_ndvi(t), "v", ["raster"], limits=(-0.3, 0.3))
    return out.select("raster", rounded(F.col("p2")).alias("p2"), rounded(F.col("p98")).alias("p98"))


@query(
    "a12_range_outside_is_ignored",
    f"WITH {NDVI_PIXELS} SELECT raster, -1::DOUBLE AS min, 1::DOUBLE AS max, count(*) AS n FROM p GROUP BY raster",
)
def _(t):
    own = formulas.FORMULAS["NDVI"].range
    out = raster.statistics(_ndvi(t), "v", ["raster"], limits=raster.accepted_range((-3.0, 0.5), own))
    return out.select("raster", "min", "max", "n")


@query(
    "a13_statistics_in_feet",
    """SELECT round(min(z) / 0.3048, 6) AS min, round(max(z) / 0.3048, 6) AS max, round(stddev_pop(z) / 0.3048, 6) AS std, count(z) AS n FROM dem""",
)
def _(t):
    out = raster.statistics(t.dem, "z", [], factor=1 / 0.3048)
    return out.select(rounded(F.col("min")).alias("min"), rounded(F.col("max")).alias("max"), rounded(F.col("std")).alias("std"), "n")


@query("a19_bounding_box", "SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM dem WHERE z > 50")
def _(t):
    return t.dem.where("z > 50").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query(
    "a20_normalized",
    """WITH e AS (SELECT min(z) AS lo, max(z) AS hi FROM dem)
    SELECT y, round(sum(CASE WHEN lo = hi THEN 128 ELSE (z - lo) * 255::DOUBLE / (hi - lo) END), 4) AS total, count(z) AS n FROM dem, e GROUP BY y""",
)
def _(t):
    return raster.stretched(t.dem, "z").groupBy("y").agg(rounded(F.sum("stretched"), 4).alias("total"), F.count("z").alias("n"))


@query("a23_all_opaque", "SELECT raster, bool_and(alpha = 255) AS opaque FROM ortho GROUP BY raster")
def _(t):
    return t.ortho.groupBy("raster").agg(raster.all_opaque(F.col("alpha")).alias("opaque"))


@query(
    "a24_rescale_over_bands",
    """WITH p AS (SELECT raster, quantile_cont(r, [0.02, 0.98]) AS r, quantile_cont(g, [0.02, 0.98]) AS g, quantile_cont(b, [0.02, 0.98]) AS b FROM ortho WHERE alpha <> 0 GROUP BY raster)
    SELECT raster, round(least(r[1], g[1], b[1]), 6) AS lo, round(greatest(r[2], g[2], b[2]), 6) AS hi FROM p""",
)
def _(t):
    bands = t.ortho.where("alpha <> 0").select("raster", F.explode(F.create_map(*(x for c in "rgb" for x in (F.lit(c), F.col(c).cast("double"))))).alias("band", "v"))
    p = raster.percentiles(bands, "v", ["raster", "band"], [0.02, 0.98]).groupBy("raster").pivot("band", list("rgb")).agg(F.first("p"))
    return p.select("raster", rounded(F.least(*(F.col(c)[0] for c in "rgb"))).alias("lo"), rounded(F.greatest(*(F.col(c)[1] for c in "rgb"))).alias("hi"))


@query(
    "a26_initial_rescale",
    """WITH s AS (SELECT raster, count(*) AS n, min(r) AS lo, max(r) AS hi FROM ortho WHERE alpha <> 0 GROUP BY raster)
    SELECT raster, CASE WHEN n = 0 THEN -1 ELSE round(lo, 6) END AS lo, CASE WHEN n = 0 THEN 1 ELSE round(hi, 6) END AS hi FROM s""",
)
def _(t):
    s = raster.statistics(t.ortho.where("alpha <> 0"), "r", ["raster"])
    return s.select("raster", F.coalesce(rounded(F.col("min")), F.lit(-1.0)).alias("lo"), F.coalesce(rounded(F.col("max")), F.lit(1.0)).alias("hi"))


@query("p20_valid_pixels", "SELECT raster, count(CASE WHEN alpha <> 0 AND r <> 0 THEN r END) AS n, count(*) AS total FROM ortho GROUP BY raster")
def _(t):
    return t.ortho.groupBy("raster").agg(F.count(raster.valid(F.col("r"), F.col("alpha"), 0.0)).alias("n"), F.count(F.lit(1)).alias("total"))


@query("s04_preview", "SELECT x, y, z FROM dem WHERE x % 4 = 0 AND y % 4 = 0")
def _(t):
    return raster.preview(t.dem, 4)


@query(
    "s05_boundless_window",
    """SELECT CAST(gx AS BIGINT) AS x, CAST(gy AS BIGINT) AS y, coalesce(d.z, -9999) AS z
    FROM range(-3, 13) a(gx), range(90, 106) b(gy) LEFT JOIN dem d ON d.x = gx AND d.y = gy""",
)
def _(t):
    return raster.read_window(t.dem, -3, 90, 16, 16, fill=-9999.0).select("x", "y", "z")


@query("s05_window", "SELECT x, y, z FROM dem WHERE x BETWEEN 10 AND 41 AND y BETWEEN 20 AND 51")
def _(t):
    return raster.read_window(t.dem, 10, 20, 32, 32)


@query("s06_map_tile", "SELECT count(z) AS n, round(sum(z), 4) AS total FROM dem WHERE x BETWEEN 64 AND 95 AND y BETWEEN 32 AND 63")
def _(t):
    size = 32  # tile (2, 1) of a grid of 32-pixel tiles
    return raster.read_window(t.dem, 2 * size, 1 * size, size, size).agg(F.count("z").alias("n"), rounded(F.sum("z"), 4).alias("total"))


@query(
    "s07_subwindows",
    """WITH n AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM dem),
    a AS (SELECT DISTINCT greatest(least(s * 28, w - 32), 0) AS x FROM (SELECT w, unnest(range(0, greatest(1, CAST(ceil(greatest(w - 4, 1) / 28) AS BIGINT)))) AS s FROM n)),
    b AS (SELECT DISTINCT greatest(least(s * 28, h - 32), 0) AS y FROM (SELECT h, unnest(range(0, greatest(1, CAST(ceil(greatest(h - 4, 1) / 28) AS BIGINT)))) AS s FROM n))
    SELECT a.x, b.y, count(d.x) AS pixels, count(d.z) AS valid FROM a, b LEFT JOIN dem d ON d.x >= a.x AND d.x < a.x + 32 AND d.y >= b.y AND d.y < b.y + 32 GROUP BY a.x, b.y""",
)
def _(t):
    """The elevation grid by windows of 32 pixels that overlap by 4: what each holds. A pixel meets its windows through blocks of 32."""
    size = t.dem.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
    cut = raster.subwindows(t.spark, size["w"], size["h"], 32, overlap=4).select(F.col("x").alias("wx"), F.col("y").alias("wy"))
    blocks = lambda c: F.explode(F.array_distinct(F.array(F.floor(F.col(c) / 32), F.floor((F.col(c) + 31) / 32))))
    cut = cut.withColumn("bx", blocks("wx")).withColumn("by", blocks("wy"))
    rows = t.dem.select("x", "y", "z", F.floor(F.col("x") / 32).alias("bx"), F.floor(F.col("y") / 32).alias("by"))
    inside = F.col("x").between(F.col("wx"), F.col("wx") + 31) & F.col("y").between(F.col("wy"), F.col("wy") + 31)
    met = cut.join(rows, ["bx", "by"], "left").groupBy(F.col("wx").alias("x"), F.col("wy").alias("y"))
    return met.agg(F.count_if(inside).alias("pixels"), F.count_if(inside & F.col("z").isNotNull()).alias("valid"))


@query("s08_blocks", "SELECT CAST(floor(x / 16) AS BIGINT) AS bx, CAST(floor(y / 16) AS BIGINT) AS by_, count(*) AS n, round(max(z), 6) AS top FROM dem GROUP BY 1, 2")
def _(t):
    bx, by = raster.block_key(F.col("x"), F.col("y"), 16)
    return t.dem.groupBy(bx.alias("bx"), by.alias("by_")).agg(F.count(F.lit(1)).alias("n"), rounded(F.max("z")).alias("top"))


@query("s09_padded_windows", "SELECT x - 16 AS x, y - 16 AS y, 64::BIGINT AS w, 64::BIGINT AS h FROM (SELECT DISTINCT CAST(floor(x / 32) * 32 AS BIGINT) AS x, CAST(floor(y / 32) * 32 AS BIGINT) AS y FROM dem)")
def _(t):
    bx, by = raster.block_key(F.col("x"), F.col("y"), 32)
    own = t.dem.select((bx * 32).alias("x"), (by * 32).alias("y")).distinct()
    names = ("x", "y", "w", "h")
    return own.select(*(c.alias(n) for c, n in zip(raster.padded(F.col("x"), F.col("y"), F.lit(32).cast("bigint"), F.lit(32).cast("bigint"), 16), names, strict=True)))


RING = [(10.0, 8.0), (80.0, 20.0), (60.0, 90.0), (35.0, 40.0), (12.0, 70.0)]
RING_SQL = " + ".join(
    f"CASE WHEN (({y0} > y + 0.5) <> ({y1} > y + 0.5)) AND x + 0.5 < (y + 0.5 - {y0}) * {(x1 - x0) / (y1 - y0)!r}::DOUBLE + {x0} THEN 1 ELSE 0 END"
    for (x0, y0), (x1, y1) in zip(RING, [*RING[1:], RING[0]], strict=True)
)
IN_RING_SQL = f"(({RING_SQL}) % 2 = 1)"


def in_ring():
    return raster.inside_polygon(F.col("x") + 0.5, F.col("y") + 0.5, RING)


@query("j12_pixels_in_polygon", f"SELECT count(*) AS n, count(z) AS n_valid, round(sum(z), 4) AS total, sum(x) AS sx, sum(y) AS sy FROM dem WHERE {IN_RING_SQL}")
def _(t):
    return t.dem.where(in_ring()).agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("n_valid"), rounded(F.sum("z"), 4).alias("total"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("r12_crop", f"SELECT x, y, CASE WHEN {IN_RING_SQL} THEN z END AS z FROM dem WHERE x BETWEEN 9 AND 80 AND y BETWEEN 7 AND 90")
def _(t):
    box = F.col("x").between(9, 80) & F.col("y").between(7, 90)
    return t.dem.where(box).select("x", "y", F.when(in_ring(), F.col("z")).alias("z"))


@query("m02_cleaning", f"SELECT CAST(CASE WHEN v = -9999 THEN 'nodata' WHEN v = 0 THEN 'zero' ELSE 'value' END AS VARCHAR) AS kind, count(*) AS n FROM (SELECT {CLEAN_SQL} AS v FROM (SELECT {INDEX_SQL['MSR']} AS v FROM ortho)) GROUP BY 1")
def _(t):
    v = formulas.index("MSR", _bands("N", "R"))
    return t.ortho.select(v.alias("v")).groupBy(F.when(F.col("v") == -9999, "nodata").when(F.col("v") == 0, "zero").otherwise("value").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("m03_rescale", "SELECT round((greatest(least(r, 0.08), 0.02) - 0.02) * 255::DOUBLE / (0.08::DOUBLE - 0.02::DOUBLE), 6) AS v, count(*) AS n FROM ortho GROUP BY 1")
def _(t):
    return t.ortho.select(rounded(raster.rescale(F.col("r"), 0.02, 0.08)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("m04_to_byte", "SELECT CAST(floor(greatest(least(b * 300, 255), 0)) AS INT) AS v, count(*) AS n FROM ortho GROUP BY 1")
def _(t):
    return t.ortho.select(raster.to_byte(F.col("b") * 300).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("m05_background", "SELECT CASE WHEN alpha = 0 THEN 255 ELSE CAST(floor(g * 200) AS INT) END AS v, count(*) AS n FROM ortho GROUP BY 1")
def _(t):
    v = raster.on_white(raster.to_byte(F.col("g") * 200), F.col("alpha"))
    return t.ortho.select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("x31_several_expressions", f"SELECT raster, count(*) FILTER (a = -9999) AS first_cleaned, count(*) FILTER (isinf(b)) AS second_left FROM (SELECT raster, {CLEAN_SQL} AS a, v AS b FROM (SELECT raster, {INDEX_SQL['BAI']} AS v FROM ortho)) GROUP BY raster")
def _(t):
    a, b = formulas.several(["BAI", "BAI"], _bands("R", "N"))
    rows = t.ortho.select("raster", a.alias("a"), b.alias("b"))
    return rows.groupBy("raster").agg(F.count_if(F.col("a") == -9999).alias("first_cleaned"), F.count_if(F.col("b") == float("inf")).alias("second_left"))


@query("x30_bound_by_order", "SELECT raster, round(min((b3 - b1) / (b3 + b1)), 6) + 0.0::DOUBLE AS lo, round(max((b3 - b1) / (b3 + b1)), 6) + 0.0::DOUBLE AS hi FROM (SELECT raster, b AS b1, r AS b2, g AS b3 FROM ortho) GROUP BY raster")
def _(t):
    make, _, at = formulas.bind("NDYI", "BRG")
    assert at == [1, 3]
    v = make({1: F.col("b"), 2: F.col("r"), 3: F.col("g")})
    return t.ortho.groupBy("raster").agg(rounded(F.min(v)).alias("lo"), rounded(F.max(v)).alias("hi"))


_VALUES = ", ".join(
    f"('{k}', [{', '.join(repr(b) for b in f.bands)}], {f.hidden})" for k, f in formulas.FORMULAS.items()
)
_FILTERS = ", ".join(f"('{f}', [{', '.join(repr(b) for b in formulas.bands_of(f))}])" for f in formulas.FILTERS)


_BAND_COUNT = "3 + p_size % 4"


@query("x32_available_indices", f"SELECT p.p_partkey AS id, count(DISTINCT a.name) AS n FROM part p JOIN (VALUES {_FILTERS}) f(filter, fb) ON len(fb) <= {_BAND_COUNT} JOIN (VALUES {_VALUES}) a(name, bands, hidden) ON NOT hidden AND list_has_all(fb, bands) GROUP BY 1")
def _(t):
    """How many indices a raster of so many bands can have: worked out once for each number of bands."""
    parts = t.part.select(F.col("p_partkey").alias("id"), F.expr(_BAND_COUNT).alias("bands_"))
    have = formulas.filter_catalog(t.spark).withColumnRenamed("bands", "fb")
    own = formulas.catalog(t.spark).where("not hidden").select("name", "bands")
    numbers = parts.select("bands_").distinct().join(have, F.size("fb") <= F.col("bands_")).join(own, F.size(F.array_except("bands", "fb")) == 0)
    return parts.join(numbers.groupBy("bands_").agg(F.count_distinct("name").alias("n")), "bands_").select("id", "n")


_NAMES = sorted(formulas.FORMULAS)


@query("x33_filters_for_index", f"SELECT p.p_partkey AS id, a.name, f.filter FROM part p JOIN (VALUES {_VALUES}) a(name, bands, hidden) ON a.name = ({_NAMES!r})[p_partkey % {len(_NAMES)} + 1] JOIN (VALUES {_FILTERS}) f(filter, fb) ON list_has_all(fb, bands)")
def _(t):
    """The camera filters with which each raster's index can be had."""
    have = formulas.filter_catalog(t.spark).withColumnRenamed("bands", "fb")
    pairs = formulas.catalog(t.spark).join(have, F.size(F.array_except("bands", "fb")) == 0).select("name", "filter")
    asked = t.part.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")).alias("name"))
    return asked.join(pairs, "name").select("id", "name", "filter")


_ALIAS_NAMES = "['red', 'R', 'Green', 'g', 'blue', 'b', 'NIR', 'n', 'RedEdge', 're', 'panchro', 'p', 'LWIR', 'l', 'thermal']"


@query("x34_band_aliases", f"SELECT s_suppkey AS id, {_ALIAS_NAMES}[s_suppkey % 15 + 1] AS alias, ['R', 'R', 'G', 'G', 'B', 'B', 'N', 'N', 'Re', 'Re', 'P', 'P', 'L', 'L', NULL][s_suppkey % 15 + 1] AS band FROM supplier")
def _(t):
    names = F.array(*(F.lit(x) for x in _ALIAS_NAMES.strip("[]").replace("'", "").split(", ")))
    alias = F.element_at(names, (F.col("s_suppkey") % 15 + 1).cast("int"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), alias.alias("alias"), formulas.letter_of(alias).alias("band"))


@query("x36_rgb_selection", "SELECT raster, round(avg(r), 6) AS c1, round(avg(g), 6) AS c2, round(avg(b), 6) AS c3 FROM ortho GROUP BY raster")
def _(t):
    bands = ["n", "b", "g", "r", "re"]
    at = formulas.rgb_positions(["undefined", "blue", "green", "red", "undefined"])
    return t.ortho.groupBy("raster").agg(*(rounded(F.avg(bands[i - 1])).alias(f"c{k}") for k, i in enumerate(at, 1)))


@query("x37_default_rescale", "SELECT raster, CAST(floor(greatest(least(((n - r) / (n + r + 1e-9) + 1) * 255 / 2, 255), 0)) AS INT) AS v, count(*) AS n FROM ortho GROUP BY 1, 2")
def _(t):
    lo, hi = formulas.render_defaults("orthophoto", "NDVI")["rescale"]
    v = (F.col("n") - F.col("r")) / (F.col("n") + F.col("r") + F.lit(1e-9))
    return t.ortho.select("raster", F.floor(F.greatest(F.least((v - lo) * 255 / (hi - lo), F.lit(255.0)), F.lit(0.0))).cast("int").alias("v")).groupBy("raster", "v").agg(F.count(F.lit(1)).alias("n"))


@query("x39_band_one_rescale", "WITH e AS (SELECT min(r) AS lo, max(r) AS hi FROM ortho WHERE alpha <> 0) SELECT CAST(floor((r - lo) * 255 / (hi - lo) + 1e-9) AS INT) AS v, count(*) AS n FROM ortho, e WHERE alpha <> 0 GROUP BY 1")
def _(t):
    rows = raster.stretched(t.ortho.where("alpha <> 0").select("r"), "r")
    return rows.select(F.floor(F.col("stretched") + 1e-9).cast("int").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m12_rgb_to_hs",
    """WITH c AS (SELECT r / 0.1 AS r, g, b FROM ortho), m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
    h AS (SELECT hi, CASE WHEN hi = lo THEN 0 WHEN r = hi THEN (g - b) / (hi - lo) WHEN g = hi THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END / 6 AS h,
          CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s FROM m)
    SELECT CAST(floor((h - floor(h)) * 24 + 1e-9) AS INT) AS hue, CAST(floor(s * 10 + 1e-9) AS INT) AS sat, count(*) AS n FROM h GROUP BY 1, 2""",
)
def _(t):
    h, s = color.rgb_to_hs(F.col("r") / 0.1, F.col("g"), F.col("b"))
    return t.ortho.select(F.floor(h * 24 + 1e-9).cast("int").alias("hue"), F.floor(s * 10 + 1e-9).cast("int").alias("sat")).groupBy("hue", "sat").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m13_hsv_to_rgb",
    """WITH c AS (SELECT l_discount * 9.9 AS h, l_quantity / 50 AS s, 0.8::DOUBLE AS v FROM lineitem),
    d AS (SELECT *, CAST(floor(h * 6) AS INT) % 6 AS i, h * 6 - floor(h * 6) AS f FROM c),
    e AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t FROM d)
    SELECT CAST(floor(255 * CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END + 1e-9) AS INT) AS r,
           CAST(floor(255 * CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END + 1e-9) AS INT) AS g,
           CAST(floor(255 * CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END + 1e-9) AS INT) AS b, count(*) AS n
    FROM e GROUP BY 1, 2, 3""",
)
def _(t):
    r, g, b = color.hsv_to_rgb(F.col("l_discount") * 9.9, F.col("l_quantity") / 50, F.lit(0.8))
    return t.lineitem.select(r.alias("r"), g.alias("g"), b.alias("b")).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@query("m14_hsv_blend", None)
def _(t):
    r, g, b = color.hsv_blend(F.col("r") / 0.1, F.col("g"), F.col("b"), F.col("n") / 0.08)
    return t.ortho.select(r.alias("r"), g.alias("g"), b.alias("b")).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@query("m16_discrete_colormap", "SELECT CAST(least(floor(CAST(i AS DOUBLE) / 256 * 5), 4) AS INT) + 1 AS colour, count(*) AS n FROM (SELECT CAST(floor(g * 255) AS INT) AS i FROM ortho) GROUP BY 1")
def _(t):
    picked = color.discrete(F.floor(F.col("g") * 255).cast("int"), color.PALETTES["discrete_ndvi"])
    at = F.array_position(F.array(*(F.lit(c) for c in color.PALETTES["discrete_ndvi"])), picked).cast("int")
    return t.ortho.groupBy(at.alias("colour")).agg(F.count(F.lit(1)).alias("n"))


_PALETTE_NAMES = sorted(color.PALETTES)


@query("m17_palettes", f"SELECT p_partkey AS id, name, cs[p_size % len(cs) + 1] AS colour FROM part JOIN (VALUES " + ", ".join(f"('{k}', [{', '.join(repr(c) for c in v)}])" for k, v in color.PALETTES.items()) + f") p(name, cs) ON name = ({_PALETTE_NAMES!r})[p_partkey % {len(_PALETTE_NAMES)} + 1]")
def _(t):
    """Classes of parts in the colours of their palette."""
    asked = t.part.select(F.col("p_partkey").alias("id"), "p_size", F.element_at(F.array(*(F.lit(n) for n in _PALETTE_NAMES)), (F.col("p_partkey") % len(_PALETTE_NAMES) + 1).cast("int")).alias("name"))
    return asked.join(color.palettes(t.spark), "name").select("id", "name", F.element_at("colours", (F.col("p_size") % F.size("colours") + 1).cast("int")).alias("colour"))


@query("j15_colormap_lookup", "SELECT substr(c, 2, 6) AS hex, count(*) AS n FROM (SELECT ['" + "','".join(color.PALETTES["discrete_ndvi"]) + "'][CAST(least(floor(CAST(floor(g * 255) AS DOUBLE) / 256 * 5), 4) AS INT) + 1] AS c FROM ortho) GROUP BY 1")
def _(t):
    table = color.colormap(t.spark, "discrete_ndvi")  # 256 rows
    rows = t.ortho.select(F.floor(F.col("g") * 255).cast("int").alias("value")).join(F.broadcast(table), "value")
    return rows.groupBy(F.substring("colour", 2, 6).alias("hex")).agg(F.count(F.lit(1)).alias("n"))


_UNIT_NAMES = [u.name for u in units.UNITS]


@query("m07_units", "SELECT p_partkey AS id, unit, kind, abbreviation, round(p_size * factor, 6) AS value, digits FROM part JOIN (VALUES " + ", ".join(f"('{u.name}', '{u.kind}', '{u.abbreviation}', {u.factor!r}::DOUBLE, {u.digits})" for u in units.UNITS) + f") t(unit, kind, abbreviation, factor, digits) ON unit = ({_UNIT_NAMES!r})[p_partkey % {len(_UNIT_NAMES)} + 1] WHERE factor IS NOT NULL")
def _(t):
    """Measures in the unit that each asks for, through the unit table."""
    asked = t.part.select(F.col("p_partkey").alias("id"), "p_size", F.element_at(F.array(*(F.lit(n) for n in _UNIT_NAMES)), (F.col("p_partkey") % len(_UNIT_NAMES) + 1).cast("int")).alias("unit"))
    rows = asked.join(units.table(t.spark), "unit").where("factor IS NOT NULL")
    return rows.select("id", "unit", "kind", "abbreviation", rounded(F.col("p_size") * F.col("factor")).alias("value"), "digits")


@query(
    "m08_automatic_units",
    """SELECT CASE WHEN v < 1 THEN 'cm' WHEN v >= 1000 THEN 'km' ELSE 'm' END AS metric, CASE WHEN v / 0.3048 >= 5280 THEN 'mi' ELSE 'ft' END AS imperial,
       CASE WHEN v >= 1000000 THEN 'km²' WHEN v >= 10000 THEN 'ha' ELSE 'm²' END AS area,
       CASE WHEN v / 0.09290304 >= 27878400 THEN 'mi²' WHEN v / 0.09290304 >= 43560 THEN 'ac' ELSE 'ft²' END AS imperial_area, count(*) AS n
    FROM (SELECT l_extendedprice * l_discount * l_quantity / 50 AS v FROM lineitem) GROUP BY ALL""",
)
def _(t):
    v = F.col("l_extendedprice") * F.col("l_discount") * F.col("l_quantity") / 50
    kinds = [units.length_unit(v, "metric").alias("metric"), units.length_unit(v, "imperial").alias("imperial"), units.area_unit(v, "metric").alias("area"), units.area_unit(v, "imperial").alias("imperial_area")]
    return t.lineitem.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))


@query("m06_to_metres", "SELECT u, round(sum(z * CASE u WHEN 'ft' THEN 0.3048::DOUBLE WHEN 'US survey foot' THEN 1200.0::DOUBLE / 3937 ELSE 1 END), 3) AS total FROM (SELECT z, CASE x % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'ft' WHEN 2 THEN 'US survey foot' ELSE 'cubit' END AS u FROM dem) GROUP BY u")
def _(t):
    unit = F.expr("CASE x % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'ft' WHEN 2 THEN 'US survey foot' ELSE 'cubit' END")
    return t.dem.withColumn("u", unit).groupBy("u").agg(rounded(F.sum(F.col("z") * units.metres(F.col("u"))), 3).alias("total"))


@query("m09_back_to_metric", "SELECT c_custkey, round(c_acctbal / ((1 / 0.3048::DOUBLE) / 5280), 4) + 0.0::DOUBLE AS metres FROM customer")
def _(t):
    return t.customer.select("c_custkey", rounded(units.to_metric(F.col("c_acctbal"), "miles"), 4).alias("metres"))


@query("m10_value_labels", "SELECT p_partkey, CASE WHEN v = floor(v) THEN format('{:,}', CAST(v AS BIGINT)) ELSE format('{:,}', CAST(floor(v) AS BIGINT)) || rtrim(substr(printf('%.2f', v - floor(v)), 2), '0') END || ' m²' AS label FROM (SELECT p_partkey, round(p_retailprice * p_size * 13, 2) AS v FROM part)")
def _(t):
    return t.part.select("p_partkey", units.label(F.col("p_retailprice") * F.col("p_size") * 13, "sqmeters").alias("label"))


@query("m11_fahrenheit", "SELECT c_custkey, round(c_acctbal * 9 / 5 + 32, 6) AS f FROM customer")
def _(t):
    return t.customer.select("c_custkey", rounded(units.fahrenheit(F.col("c_acctbal"))).alias("f"))


@query("f08_hex_to_rgb", "SELECT hex, CASE WHEN regexp_full_match(hex, '#?[0-9a-f]{6}') THEN ('0x' || substr(replace(hex, '#', ''), 1, 2))::INT ELSE 255 END AS r, CASE WHEN regexp_full_match(hex, '#?[0-9a-f]{6}') THEN ('0x' || substr(replace(hex, '#', ''), 5, 2))::INT ELSE 255 END AS b, count(*) AS n FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'zz' ELSE '#' || substr(md5(p_brand), 1, 6) END AS hex FROM part) GROUP BY ALL")
def _(t):
    hexes = F.expr("CASE WHEN p_size % 7 = 0 THEN 'zz' ELSE '#' || substr(md5(p_brand), 1, 6) END")
    rows = t.part.select(hexes.alias("hex")).groupBy("hex").agg(F.count(F.lit(1)).alias("n"))
    r, _, b = color.hex_to_rgb(F.col("hex"))
    return rows.select("hex", r.alias("r"), b.alias("b"), "n")


@query("f09_packed_colours", "SELECT p_size, p_size % 256 * 16777216::BIGINT + 200 * 65536 + 7 * 256 + 255 AS packed, count(*) AS n FROM (SELECT p_size * 5 AS p_size FROM part) GROUP BY ALL")
def _(t):
    size = F.col("p_size") * 5
    return t.part.groupBy(size.alias("p_size")).agg(F.count(F.lit(1)).alias("n")).select("p_size", color.pack(F.col("p_size") % 256, F.lit(200), F.lit(7), F.lit(255)).alias("packed"), "n")


@query("f35_unpacked_colours", "SELECT p_size % 256 AS r, 200 AS g, 7 AS b, 255 AS a, count(*) AS n FROM (SELECT p_size * 5 AS p_size FROM part) GROUP BY ALL")
def _(t):
    packed = color.pack(F.col("p_size") * 5 % 256, F.lit(200), F.lit(7), F.lit(255))
    return t.part.groupBy(*(c.alias(n) for c, n in zip(color.unpack(packed), "rgba", strict=True))).agg(F.count(F.lit(1)).alias("n"))


@query("f37_complement", "SELECT hex, '#' || printf('%02x%02x%02x', 255 - ('0x' || substr(hex, 2, 2))::INT, 255 - ('0x' || substr(hex, 4, 2))::INT, 255 - ('0x' || substr(hex, 6, 2))::INT) AS other FROM (SELECT DISTINCT '#' || substr(md5(p_brand), 1, 6) AS hex FROM part)")
def _(t):
    rows = t.part.select(F.expr("'#' || substr(md5(p_brand), 1, 6)").alias("hex")).distinct()
    return rows.select("hex", color.complement(F.col("hex")).alias("other"))
