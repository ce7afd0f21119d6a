"""Queries on the elevation grid and on plane geometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyquarry.functions import geometry as g
from skyquarry.functions.ieee import half_away, rounded
from skyquarry.functions.scalars import light
from skyquarry.operators import clouds, reproject, views
from skyquarry.operators import depressions as dp
from skyquarry.operators import polygons as pg
from skyquarry.operators import terrain as te
from skyquarry.plans.raster import IN_RING_SQL, RING
from skyquarry.plans.registry import query

GRADIENT_SQL = """
  g0 AS (SELECT x, y, z, lag(z) OVER r AS zl, lead(z) OVER r AS zr, lag(z) OVER c AS zu, lead(z) OVER c AS zd,
                row_number() OVER r AS ix, count(*) OVER (PARTITION BY y) AS nx, row_number() OVER c AS iy, count(*) OVER (PARTITION BY x) AS ny
         FROM dem WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
  gr AS (SELECT x, y, z, CASE WHEN ix = 1 THEN zr - z WHEN ix = nx THEN z - zl ELSE (zr - zl) / 2 END AS gx,
                CASE WHEN iy = 1 THEN (zd - z) / -1 WHEN iy = ny THEN (z - zu) / -1 ELSE (zd - zu) / -2 END AS gy FROM g0)"""


def shade_sql(azimuth, altitude):
    lx, ly, lz = light(azimuth, altitude)
    return f"CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN greatest(least((gx * {-lx!r}::DOUBLE + gy * {-ly!r}::DOUBLE + {lz!r}::DOUBLE) / sqrt(gx * gx + gy * gy + 1), 1), 0) END"


@query("w01_gradient", f"WITH {GRADIENT_SQL} SELECT x, y, round(gx, 6) + 0.0::DOUBLE AS gx, round(gy, 6) + 0.0::DOUBLE AS gy FROM gr")
def _(t):
    return te.gradient(t.dem, 1.0, -1.0).select("x", "y", rounded(F.col("gx")).alias("gx"), rounded(F.col("gy")).alias("gy"))


@query("r01_hillshade", f"WITH {GRADIENT_SQL} SELECT x, y, round({shade_sql(315.0, 45.0)}, 6) + 0.0::DOUBLE AS shade FROM gr")
def _(t):
    return te.hillshade(t.dem).select("x", "y", rounded(F.col("shade")).alias("shade"))


_R2 = te.hillshade_spacing(0.5)


@query("r02_export_hillshade", f"WITH {GRADIENT_SQL}, s AS (SELECT x, y, gx / {_R2} AS gx, gy / {_R2} AS gy FROM gr) SELECT y, round(avg({shade_sql(315.0, 45.0)}), 6) AS shade, count(gx + gy) AS n FROM s GROUP BY y")
def _(t):
    rows = te.hillshade(t.dem, _R2, -_R2)
    return rows.groupBy("y").agg(rounded(F.avg("shade")).alias("shade"), F.count("shade").alias("n"))


_MULTI = " + ".join(f"{w}::DOUBLE * {shade_sql(a, 30.0)}" for a, w in te.DIRECTIONS)


@query("r04_multidirectional", f"WITH {GRADIENT_SQL}, m AS (SELECT x, y, {_MULTI} AS m FROM gr), e AS (SELECT min(m) AS lo, max(m) AS hi FROM m) SELECT y, round(avg(CASE WHEN lo = hi THEN 128 ELSE (m - lo) * 255 / (hi - lo) END), 4) AS shade FROM m, e GROUP BY y")
def _(t):
    return te.multidirectional(t.dem).groupBy("y").agg(rounded(F.avg("shade"), 4).alias("shade"))


def _touched_sql():
    out = [IN_RING_SQL]
    for (x0, y0), (x1, y1) in zip(RING, [*RING[1:], RING[0]], strict=True):
        s = [f"((x + {i} - {x0}) * {y1 - y0} - (y + {j} - {y0}) * {x1 - x0})" for i in (0, 1) for j in (0, 1)]
        out.append(f"(x <= {max(x0, x1)} AND x + 1 >= {min(x0, x1)} AND y <= {max(y0, y1)} AND y + 1 >= {min(y0, y1)} AND least({', '.join(s)}) <= 0 AND greatest({', '.join(s)}) >= 0)")
    return " OR ".join(out)


_CORNERS = " OR ".join(f"(x = {math.floor(a)} AND y = {math.floor(b)})" for a, b in RING)
for _method, _base in (("average", "(SELECT avg(z) FROM v)"), ("highest", "(SELECT max(z) FROM v)"), ("lowest", "(SELECT min(z) FROM v)"), ("custom", "100::DOUBLE")):

    @query(f"r05_volume_{_method}", f"WITH v AS (SELECT z FROM dem WHERE {_CORNERS}) SELECT count(z) AS n, abs(round(sum(z - {_base}) * 0.25, 4)) AS volume FROM dem WHERE {_touched_sql()}")
    def _(t, method=_method):
        return te.volume(t.dem, RING, method, custom=100.0, pixel_area=0.25)


_PLANE = """WITH p AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, z FROM {rows}),
  s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM p WHERE z IS NOT NULL),
  m AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS m1, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS m2 FROM s)"""


@query("r05_volume_plane", _PLANE.format(rows=f"(SELECT x, y, z FROM dem WHERE {_CORNERS})") + f" SELECT count(d.z) AS n, abs(round(sum(d.z - (m1 * d.x + m2 * d.y + mz - m1 * mx - m2 * my)), 3)) AS volume FROM (SELECT x, y, z FROM dem WHERE {_touched_sql()}) d, m")
def _(t):
    return te.volume(t.dem, RING, "plane", digits=3)


@query("r06_volume_triangulated")
def _(t):
    return te.volume(t.dem, RING, "triangulate")


@query("a14_volume_sum", "SELECT round(sum(z - 50) * 0.01, 4) AS total, count(z) AS n FROM dem")
def _(t):
    return t.dem.agg(rounded(F.sum(F.col("z") - 50) * 0.01, 4).alias("total"), F.count("z").alias("n"))


@query("a15_vertex_elevations", f"SELECT round(avg(z), 6) AS mean, max(z) AS top, min(z) AS low FROM dem WHERE {_CORNERS}")
def _(t):
    at = F.lit(False)
    for a, b in RING:
        at = at | ((F.col("x") == math.floor(a)) & (F.col("y") == math.floor(b)))
    return t.dem.where(at).agg(rounded(F.avg("z")).alias("mean"), F.max("z").alias("top"), F.min("z").alias("low"))


@query("a16_plane_fit", _PLANE.format(rows="dem") + " SELECT round(m1, 6) + 0.0::DOUBLE AS m1, round(m2, 6) + 0.0::DOUBLE AS m2, round(mz - m1 * mx - m2 * my, 5) AS b FROM m")
def _(t):
    return te.plane_fit(t.dem).select(rounded(F.col("m1")).alias("m1"), rounded(F.col("m2")).alias("m2"), rounded(F.col("b"), 5).alias("b"))


_CELLS = """WITH a AS (SELECT x, y, z AS a, lead(z) OVER (PARTITION BY y ORDER BY x) AS b FROM dem),
  c AS (SELECT x, y, a, b, lead(a) OVER w AS d, lead(b) OVER w AS c FROM a WINDOW w AS (PARTITION BY x ORDER BY y)),
  l AS (SELECT *, unnest(range(CAST(floor(least(a, b, c, d) / 50) AS BIGINT) + 1, CAST(floor(greatest(a, b, c, d) / 50) AS BIGINT) + 1)) * 50::DOUBLE AS level
        FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL)"""


@query("r07_contours", f"{_CELLS} SELECT level, CAST(sum(CASE WHEN ((a < level) <> (b < level)) AND ((b < level) <> (c < level)) AND ((c < level) <> (d < level)) THEN 2 ELSE 1 END) AS BIGINT) AS n FROM l WHERE ((a < level) <> (b < level)) OR ((b < level) <> (c < level)) OR ((d < level) <> (c < level)) GROUP BY level")
def _(t):
    return te.contour_segments(t.dem, 50.0).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("r08_contour_lines")
def _(t):
    return te.contour_lines(te.contour_segments(t.dem, 100.0), shortest=1.0).select(F.round("level", 5).alias("level"), F.round("length", 4).alias("length"), F.size("points").alias("n"))


@query(
    "r09_viewshed",
    """WITH e AS (SELECT z + 1.7 AS eye FROM dem WHERE x = 50 AND y = 50),
    c AS (SELECT x, y, z, greatest(abs(x - 50), abs(y - 50)) AS n FROM dem WHERE z IS NOT NULL AND (x - 50) * (x - 50) + (y - 50) * (y - 50) <= 900),
    s AS (SELECT c.x, c.y, c.n, k, CAST(50 + floor((c.x - 50) * k / c.n + 0.5) AS BIGINT) AS sx, CAST(50 + floor((c.y - 50) * k / c.n + 0.5) AS BIGINT) AS sy FROM (SELECT *, unnest(range(1, n)) AS k FROM c) c),
    r AS (SELECT s.x, s.y, max((d.z - eye) * s.n / k) AS rise FROM s JOIN dem d ON d.x = sx AND d.y = sy AND d.z IS NOT NULL, e GROUP BY ALL)
    SELECT c.x, c.y, CASE WHEN coalesce(c.z - eye >= rise, true) THEN 255 ELSE 0 END AS visible FROM c LEFT JOIN r ON c.x = r.x AND c.y = r.y, e""",
)
def _(t):
    return te.viewshed(t.dem, 50, 50, radius=30)


@query(
    "r09_viewshed_whole",
    """WITH e AS (SELECT z + 1.7 AS eye FROM dem WHERE x = 50 AND y = 50),
    c AS (SELECT x, y, z, greatest(abs(x - 50), abs(y - 50)) AS n FROM dem WHERE z IS NOT NULL),
    s AS (SELECT c.x, c.y, c.n, k, CAST(50 + floor((c.x - 50) * k / c.n + 0.5) AS BIGINT) AS sx, CAST(50 + floor((c.y - 50) * k / c.n + 0.5) AS BIGINT) AS sy FROM (SELECT *, unnest(range(1, n)) AS k FROM c) c),
    r AS (SELECT s.x, s.y, max((d.z - eye) * s.n / k) AS rise FROM s JOIN dem d ON d.x = sx AND d.y = sy AND d.z IS NOT NULL, e GROUP BY ALL)
    SELECT c.x, c.y, CASE WHEN coalesce(c.z - eye >= rise, true) THEN 255 ELSE 0 END AS visible FROM c LEFT JOIN r ON c.x = r.x AND c.y = r.y, e""",
)
def _(t):
    return te.viewshed(t.dem, 50, 50)


@query(
    "r09_viewshed_rings",
    """WITH RECURSIVE e AS (SELECT z + 1.7::DOUBLE AS eye FROM dem WHERE x = 50 AND y = 50),
    c AS (SELECT x, y, z - eye AS rise, greatest(abs(x - 50), abs(y - 50)) AS r, least(abs(x - 50), abs(y - 50)) AS t, sign(x - 50) AS sx, sign(y - 50) AS sy, abs(x - 50) >= abs(y - 50) AS wide FROM dem, e),
    p AS MATERIALIZED (
      SELECT x, y, r, rise, x - sx AS px, y - sy AS py, CASE WHEN t = r THEN r ELSE t END / (r - 1)::DOUBLE AS share FROM c WHERE r > 1 AND t > 0
      UNION ALL SELECT x, y, r, rise, CASE WHEN wide THEN x - sx ELSE x END, CASE WHEN wide THEN y ELSE y - sy END, CASE WHEN t = 0 THEN r ELSE r - t END / (r - 1)::DOUBLE FROM c WHERE r > 1 AND t < r),
    w AS (SELECT x, y, r, rise, -1e300::DOUBLE AS line, coalesce(rise, -1e300::DOUBLE) AS hides FROM c WHERE r = 1
      UNION ALL SELECT x, y, r, rise, line, greatest(rise, line) FROM (SELECT p.x, p.y, p.r, any_value(p.rise) AS rise, greatest(sum(share * w.hides), -1e300) AS line FROM w JOIN p ON p.px = w.x AND p.py = w.y AND p.r = w.r + 1 GROUP BY p.x, p.y, p.r))
    SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CASE WHEN rise >= line - 1e-9 THEN 255 ELSE 0 END AS visible FROM w WHERE rise IS NOT NULL UNION ALL SELECT 50, 50, 255 FROM e WHERE eye IS NOT NULL""",
)
def _(t):
    return views.viewshed(t.dem, 50, 50)


_RASTER = "SELECT CAST(event_id % 100 AS BIGINT) AS x, CAST(floor(event_id / 100) AS BIGINT) AS y, value AS z FROM events"


def _raster(t):
    """All readings as heights, those of errors included: a grid without holes."""
    return t.events.selectExpr("CAST(event_id % 100 AS BIGINT) AS x", "CAST(floor(event_id / 100) AS BIGINT) AS y", "value AS z")


@query("r10_breached")
def _(t):
    return dp.breached(_raster(t), 128).select("x", "y", "z", "level", "direction")


@query("r10_breached_accumulation")
def _(t):
    return te.accumulation(te.d8_pointer(dp.breached(_raster(t), 128).select("x", "y", "z")))


_N8 = "(VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(te.NEIGHBOURS)) + ") n(i, sx, sy)"
POINTER_SQL = f"""d8 AS (SELECT x, y, z, CASE WHEN coalesce(max(drop_), -1) > 0 THEN CAST(arg_min(i, (-drop_, i)) AS INT) ELSE -1 END AS direction
  FROM (SELECT d.x, d.y, d.z, i, (d.z - o.z) / sqrt(sx * sx + sy * sy) AS drop_ FROM dem d, {_N8} LEFT JOIN dem o ON o.x = d.x + sx AND o.y = d.y + sy WHERE d.z IS NOT NULL) GROUP BY x, y, z)"""


@query("r10_d8_pointer", f"WITH {POINTER_SQL} SELECT x, y, direction FROM d8")
def _(t):
    return te.d8_pointer(t.dem).select("x", "y", "direction")


_FLOW = f"{POINTER_SQL}, f AS (SELECT d8.x, d8.y, d8.x + coalesce(sx, 0) AS tx, d8.y + coalesce(sy, 0) AS ty FROM d8 LEFT JOIN {_N8} ON i = direction)"


@query("r10_accumulation", f"WITH RECURSIVE {_FLOW}, w AS (SELECT x AS sx, y AS sy, x, y FROM f UNION ALL SELECT w.sx, w.sy, f.tx, f.ty FROM w JOIN f ON f.x = w.x AND f.y = w.y WHERE f.tx <> f.x OR f.ty <> f.y) SELECT x, y, count(*) AS cells FROM w GROUP BY 1, 2")
def _(t):
    return te.accumulation(te.d8_pointer(t.dem))


def _pour(t):
    acc = te.accumulation(te.d8_pointer(t.dem))
    return te.snap(acc, 50, 50, te.snap_radius(10.0, 1.0))


@query("r11_snap", f"WITH RECURSIVE {_FLOW}, w AS (SELECT x AS sx, y AS sy, x, y FROM f UNION ALL SELECT w.sx, w.sy, f.tx, f.ty FROM w JOIN f ON f.x = w.x AND f.y = w.y WHERE f.tx <> f.x OR f.ty <> f.y), a AS (SELECT x, y, count(*) AS cells FROM w GROUP BY 1, 2) SELECT x, y, cells FROM a WHERE x BETWEEN 40 AND 60 AND y BETWEEN 40 AND 60 AND cells > 1 ORDER BY cells DESC, y, x LIMIT 1")
def _(t):
    return _pour(t)


def _basin(t):
    """The pour point's watershed; nothing where no water flows."""
    at = _pour(t).first()
    return te.watershed(te.d8_pointer(t.dem), at["x"], at["y"]) if at else t.dem.where("false").select("x", "y")


@query(
    "r10_watershed",
    f"WITH RECURSIVE {_FLOW}, w AS (SELECT x AS sx, y AS sy, x, y FROM f UNION ALL SELECT w.sx, w.sy, f.tx, f.ty FROM w JOIN f ON f.x = w.x AND f.y = w.y WHERE f.tx <> f.x OR f.ty <> f.y), a AS (SELECT x, y, count(*) AS cells FROM w GROUP BY 1, 2), "
    "p AS (SELECT x AS px, y AS py FROM a WHERE x BETWEEN 40 AND 60 AND y BETWEEN 40 AND 60 AND cells > 1 ORDER BY cells DESC, y, x LIMIT 1) SELECT sx AS x, sy AS y FROM w JOIN p ON x = px AND y = py",
)
def _(t):
    return _basin(t)


@query("a17_watershed_area", f"WITH RECURSIVE {_FLOW}, w AS (SELECT x AS sx, y AS sy, x, y FROM f UNION ALL SELECT w.sx, w.sy, f.tx, f.ty FROM w JOIN f ON f.x = w.x AND f.y = w.y WHERE f.tx <> f.x OR f.ty <> f.y), a AS (SELECT x, y, count(*) AS cells FROM w GROUP BY 1, 2) SELECT cells * 0.25::DOUBLE AS area FROM a WHERE x BETWEEN 40 AND 60 AND y BETWEEN 40 AND 60 ORDER BY cells DESC, y, x LIMIT 1")
def _(t):
    return _basin(t).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select((F.col("n") * F.lit(0.25)).alias("area"))


@query("a18_windowed_argmax", "SELECT x, y, z FROM dem WHERE x BETWEEN 20 AND 80 AND y BETWEEN 20 AND 80 AND z IS NOT NULL ORDER BY z DESC, y, x LIMIT 1")
def _(t):
    near = t.dem.where(F.col("x").between(20, 80) & F.col("y").between(20, 80) & F.col("z").isNotNull())
    best = near.agg(F.max(F.struct("z", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("m"))
    return best.select((-F.col("m.nx")).alias("x"), (-F.col("m.ny")).alias("y"), F.col("m.z").alias("z"))


_LONLAT = "SELECT c_custkey AS id, c_acctbal / 60 AS lon, CAST(c_nationkey * 6 - 72 AS DOUBLE) AS lat FROM customer"


@query("r13_to_mercator", f"SELECT id, round(radians(lon) * 6378137, 3) + 0.0::DOUBLE AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137, 3) + 0.0::DOUBLE AS y FROM ({_LONLAT})")
def _(t):
    rows = t.customer.selectExpr("c_custkey AS id", "c_acctbal / 60 AS lon", "CAST(c_nationkey * 6 - 72 AS DOUBLE) AS lat")
    x, y = g.to_mercator(F.col("lon"), F.col("lat"))
    return rows.select("id", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query("r13_round_trip", f"SELECT id, round(lon, 6) + 0.0::DOUBLE AS lon, round(lat, 6) + 0.0::DOUBLE AS lat FROM ({_LONLAT})")
def _(t):
    rows = t.customer.selectExpr("c_custkey AS id", "c_acctbal / 60 AS lon", "CAST(c_nationkey * 6 - 72 AS DOUBLE) AS lat")
    lon, lat = g.from_mercator(*g.to_mercator(F.col("lon"), F.col("lat")))
    return rows.select("id", rounded(lon).alias("lon"), rounded(lat).alias("lat"))


_TARGETS = "SELECT event_id AS id, (event_id % 100) * 0.73::DOUBLE + 1.1 AS sx, floor(event_id / 100) * 0.61::DOUBLE + 0.9 AS sy FROM events"


def _targets(t):
    return t.events.selectExpr("event_id AS id", "(event_id % 100) * 0.73D + 1.1D AS sx", "floor(event_id / 100) * 0.61D + 0.9D AS sy")


@query("r13_resampled_nearest", f"SELECT id, z FROM ({_TARGETS}) LEFT JOIN dem ON x = CAST(floor(sx) AS BIGINT) AND y = CAST(floor(sy) AS BIGINT)")
def _(t):
    return te.resampled(t.dem, _targets(t)).select("id", "z")


@query(
    "r13_resampled_bilinear",
    f"""WITH p AS (SELECT id, CAST(floor(sx - 0.5) AS BIGINT) AS px, CAST(floor(sy - 0.5) AS BIGINT) AS py, sx - 0.5 - floor(sx - 0.5) AS u, sy - 0.5 - floor(sy - 0.5) AS v FROM ({_TARGETS}))
    SELECT id, round((a.z * (1 - u) + b.z * u) * (1 - v) + (c.z * (1 - u) + d.z * u) * v, 6) AS z FROM p LEFT JOIN dem a ON a.x = px AND a.y = py LEFT JOIN dem b ON b.x = px + 1 AND b.y = py
    LEFT JOIN dem c ON c.x = px AND c.y = py + 1 LEFT JOIN dem d ON d.x = px + 1 AND d.y = py + 1""",
)
def _(t):
    return te.resampled(t.dem, _targets(t), "bilinear").select("id", rounded(F.col("z")).alias("z"))


@query(
    "r13_to_utm",
    """WITH c AS (SELECT id, radians(lon - 9) AS dl, radians(lat) AS phi, sin(radians(lat)) AS s, 0.0818191908426214957::DOUBLE AS e FROM ({lonlat})),
    t AS (SELECT id, dl, (exp(asinh_s - e * atanh_s) - exp(-(asinh_s - e * atanh_s))) / 2 AS tau FROM (SELECT id, dl, e, 0.5 * ln((1 + s) / (1 - s)) AS asinh_s, 0.5 * ln((1 + e * s) / (1 - e * s)) AS atanh_s FROM c)),
    x AS (SELECT id, atan2(tau, cos(dl)) AS xi, 0.5 * ln((1 + sin(dl) / sqrt(1 + tau * tau)) / (1 - sin(dl) / sqrt(1 + tau * tau))) AS eta FROM t)
    SELECT id, round(500000 + 0.9996 * 6367449.145823415::DOUBLE * (eta + {eta}), 2) AS easting, round(0.9996 * 6367449.145823415::DOUBLE * (xi + {xi}), 2) + 0.0::DOUBLE AS northing FROM x""".format(
        lonlat="SELECT c_custkey AS id, 9 + c_acctbal / 5000 AS lon, CAST(c_nationkey * 6 - 72 AS DOUBLE) AS lat FROM customer",
        eta=" + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(g.KRUGER, 1)),
        xi=" + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(g.KRUGER, 1)),
    ),
)
def _(t):
    rows = t.customer.selectExpr("c_custkey AS id", "9 + c_acctbal / 5000 AS lon", "CAST(c_nationkey * 6 - 72 AS DOUBLE) AS lat")
    east, north = g.to_utm(F.col("lon"), F.col("lat"), 32, south=False)
    return rows.select("id", rounded(east, 2).alias("easting"), rounded(north, 2).alias("northing"))


_SIZE = "s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM dem)"
for _pad, _side in ((False, "least"), (True, "greatest")):

    @query(
        "r14_thumbnail" + "_padded" * _pad,
        f"""WITH {_SIZE}, c AS (SELECT {_side}(w, h) AS side, w, h FROM s),
        g AS (SELECT CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, CAST(floor((tx + 0.5::DOUBLE) * side / 16) + floor((w - side) / 2::DOUBLE) AS BIGINT) AS x, CAST(floor((ty + 0.5::DOUBLE) * side / 16) + floor((h - side) / 2::DOUBLE) AS BIGINT) AS y
              FROM range(16) a(tx), range(16) b(ty), c)
        SELECT tx, ty, d.z FROM g LEFT JOIN dem d ON d.x = g.x AND d.y = g.y""",
    )
    def _(t, pad=_pad):
        size = t.dem.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
        return te.thumbnail(t.dem, size["w"], size["h"], 16, pad)


@query("r17_thinned_points", "SELECT x, y, z FROM (SELECT l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, row_number() OVER (PARTITION BY floor(l_quantity / 3), floor(l_discount * 100 / 3), floor(l_tax * 100 / 3) ORDER BY l_quantity, l_discount, l_tax) AS k FROM lineitem) WHERE k = 1")
def _(t):
    return te.thinned(t.lineitem.selectExpr("l_quantity AS x", "l_discount * 100 AS y", "l_tax * 100 AS z"), 3.0)


_RECT = "SELECT c_custkey AS id, c_acctbal / 100 AS x0, CAST(c_nationkey AS DOUBLE) AS y0, c_acctbal / 100 + 7 AS x1, CAST(c_nationkey + 5 AS DOUBLE) AS y1 FROM customer"


def _rectangles(t):
    p = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    rows = t.customer.selectExpr("c_custkey AS id", "c_acctbal / 100 AS x0", "CAST(c_nationkey AS DOUBLE) AS y0", "c_acctbal / 100 + 7 AS x1", "CAST(c_nationkey + 5 AS DOUBLE) AS y1")
    return rows.withColumn("ring", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")))


@query("g02_clipped_crops", f"SELECT id, CASE WHEN w > 0 AND h > 0 THEN round(w * h, 6) END AS area FROM (SELECT id, least(x1, 60) - greatest(x0, 10) AS w, least(y1, 20) - greatest(y0, 3) AS h FROM ({_RECT}))")
def _(t):
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(3.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(20.0).alias("y1"))
    return _rectangles(t).select("id", rounded(g.ring_area(g.clipped(F.col("ring"), box))).alias("area"))


@query("g03_pixel_boxes", f"SELECT id, round((x0 - 5) / 0.5, 6) + 0.0::DOUBLE AS c0, round((40 - y1) / 0.25, 6) + 0.0::DOUBLE AS r0, round((x1 - 5) / 0.5, 6) + 0.0::DOUBLE AS c1, round((40 - y0) / 0.25, 6) + 0.0::DOUBLE AS r1 FROM ({_RECT})")
def _(t):
    inverse = g.inverse_affine((0.5, 0, 5, 0, -0.25, 40))
    def point(p):
        c, r = g.affine(p["x"], p["y"], inverse)
        return F.struct(c.alias("x"), r.alias("y"))

    rows = _rectangles(t).select("id", g.ring_box(F.transform("ring", point)).alias("b"))
    return rows.select("id", *(rounded(F.col(f"b.{k}")).alias(n) for k, n in (("x0", "c0"), ("y0", "r0"), ("x1", "c1"), ("y1", "r1"))))


@query("g05_raster_bounds", "SELECT CAST(min(x) * 0.5 + 5 AS DOUBLE) AS x0, CAST(40 - (max(y) + 1) * 0.25 AS DOUBLE) AS y0, CAST((max(x) + 1) * 0.5 + 5 AS DOUBLE) AS x1, CAST(40 - min(y) * 0.25 AS DOUBLE) AS y1 FROM dem")
def _(t):
    ends = t.dem.agg(F.min("x").alias("a"), F.min("y").alias("b"), (F.max("x") + 1).alias("c"), (F.max("y") + 1).alias("d"))
    (x0, y1), (x1, y0) = (g.affine(F.col(p), F.col(q), (0.5, 0, 5, 0, -0.25, 40)) for p, q in (("a", "b"), ("c", "d")))
    return ends.select(rounded(x0).alias("x0"), rounded(y0).alias("y0"), rounded(x1).alias("x1"), rounded(y1).alias("y1"))


@query("g08_extents", f"SELECT id, [round(x0, 4), y0, round(x1, 4), y1] AS extent FROM ({_RECT})")
def _(t):
    b = g.ring_box(F.col("ring"))
    return _rectangles(t).select("id", b.alias("b")).select("id", F.array(half_away(F.col("b.x0"), 4), "b.y0", half_away(F.col("b.x1"), 4), "b.y1").alias("extent"))


@query("g09_buffered", f"SELECT round(min(x0) - 2.5, 6) AS x0, min(y0) - 2.5 AS y0, round(max(x1) + 2.5, 6) AS x1, max(y1) + 2.5 AS y1 FROM ({_RECT})")
def _(t):
    ends = _rectangles(t).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return ends.select(*(rounded(c).alias(n) for c, n in zip(g.buffered(*(F.col(n) for n in ("x0", "y0", "x1", "y1")), 2.5), ("x0", "y0", "x1", "y1"), strict=True)))


@query("g10_ring_length_and_area", f"SELECT id, 24.0::DOUBLE AS length, 35.0::DOUBLE AS area FROM ({_RECT})")
def _(t):
    return _rectangles(t).select("id", rounded(g.ring_length(F.col("ring"))).alias("length"), rounded(g.ring_area(F.col("ring"))).alias("area"))


@query("g11_geojson_rings", "SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS x, 3::INT AS n FROM customer")
def _(t):
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[[['), F.col("c_nationkey").cast("string"), F.lit(",0],[5,5],[9,1]]]}"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), text, F.lit("}"))).otherwise(text)
    rows = t.customer.select(F.col("c_custkey").alias("id"), g.geojson_ring(text).alias("ring"))
    return rows.select("id", F.col("ring")[0]["x"].alias("x"), F.size("ring").alias("n"))


@query("g12_snapped_segments", "SELECT c_custkey AS id, round(cos(a) * len, 5) + 0.0::DOUBLE AS x, round(sin(a) * len, 5) + 0.0::DOUBLE AS y FROM (SELECT c_custkey, floor(atan2(c_acctbal, c_nationkey + 1) / radians(30) + 0.5) * radians(30) AS a, sqrt(c_acctbal * c_acctbal + (c_nationkey + 1) * (c_nationkey + 1)) AS len FROM customer)")
def _(t):
    x, y = g.snapped(F.lit(0.0), F.lit(0.0), F.col("c_nationkey") + 1, F.col("c_acctbal"))
    return t.customer.select(F.col("c_custkey").alias("id"), rounded(x, 5).alias("x"), rounded(y, 5).alias("y"))


_IN_RECT = "x + 0.5 >= x0 AND x + 0.5 < x1 AND y + 0.5 >= y0 AND y + 0.5 < y1"
_ON_RECT = "x + 1 >= x0 AND x <= x1 AND y + 1 >= y0 AND y <= y1"


@query("j12_pixels_in_polygons", f"SELECT id, count(*) AS n, count(z) AS valid, round(sum(z), 4) AS total FROM ({_RECT}) JOIN dem ON {_IN_RECT} GROUP BY id")
def _(t):
    found = pg.in_polygons(t.dem, _rectangles(t).select("id", "ring"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("valid"), rounded(F.sum("z"), 4).alias("total"))


@query("r12_crops", f"SELECT id, x, y, z FROM ({_RECT}) JOIN dem ON {_IN_RECT}")
def _(t):
    return pg.in_polygons(t.dem, _rectangles(t).select("id", "ring"))


_RECT_CORNERS = "SELECT id, cx, cy, z, d.x IS NOT NULL AS there FROM (SELECT id, unnest([floor(x0), floor(x1), floor(x1), floor(x0)]) AS cx, unnest([floor(y0), floor(y0), floor(y1), floor(y1)]) AS cy FROM ({rect})) LEFT JOIN dem d ON d.x = cx AND d.y = cy"
_ON_ALL = f"SELECT id, x, y, z FROM ({_RECT}) JOIN dem ON {_ON_RECT}"


@query(
    "r05_volumes_of_polygons",
    f"""WITH v AS ({_RECT_CORNERS.format(rect=_RECT)}), b AS (SELECT id, CASE WHEN bool_and(there) THEN avg(z) END AS base FROM v GROUP BY id),
    s AS (SELECT p.id, count(z) AS n, abs(round(sum(z - base), 4)) AS volume FROM ({_ON_ALL}) p JOIN b ON b.id = p.id GROUP BY p.id)
    SELECT r.id, coalesce(n, 0) AS n, volume FROM ({_RECT}) r LEFT JOIN s ON s.id = r.id""",
)
def _(t):
    return pg.volumes(t.dem, _rectangles(t).select("id", "ring"), "average")


@query(
    "r05_volumes_over_planes",
    f"""WITH v AS ({_RECT_CORNERS.format(rect=_RECT)}),
    c AS (SELECT id, bool_and(there) AS there, avg(cx) FILTER (z IS NOT NULL) AS mx, avg(cy) FILTER (z IS NOT NULL) AS my, avg(z) AS mz, covar_pop(cx, cx) FILTER (z IS NOT NULL) AS xx, covar_pop(cy, cy) FILTER (z IS NOT NULL) AS yy,
          covar_pop(cx, cy) FILTER (z IS NOT NULL) AS xy, covar_pop(cx, z) AS xz, covar_pop(cy, z) AS yz FROM v GROUP BY id),
    m AS (SELECT *, (xz * yy - yz * xy) / d AS m1, (yz * xx - xz * xy) / d AS m2 FROM (SELECT *, CASE WHEN there AND xx * yy - xy * xy > 1e-12 THEN xx * yy - xy * xy END AS d FROM c)),
    s AS (SELECT p.id, count(z) AS n, abs(round(sum(z - (m1 * x + m2 * y + mz - m1 * mx - m2 * my)), 4)) AS volume FROM ({_ON_ALL}) p JOIN m ON m.id = p.id GROUP BY p.id)
    SELECT r.id, coalesce(n, 0) AS n, volume FROM ({_RECT}) r LEFT JOIN s ON s.id = r.id""",
)
def _(t):
    return pg.volumes(t.dem, _rectangles(t).select("id", "ring"), "plane")


@query("r17_sampled_points")
def _(t):
    return clouds.sampled(t.lineitem.selectExpr("l_quantity AS x", "l_discount * 100 AS y", "l_tax * 100 AS z"), 3.0)


for _method in ("nearest", "bilinear"):

    @query(f"r13_reprojected_{_method}")
    def _(t, method=_method):
        """The elevation grid, laid over degrees, in zone 32."""
        size = t.dem.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
        source = reproject.Grid(8.5, 47.0, 0.0004, 0.0003, size["w"], size["h"])
        target = reproject.target_grid(t.spark, source, lambda lon, lat: g.to_utm(lon, lat, 32))
        out = reproject.reprojected(t.dem, source, target, lambda x, y: g.from_utm(x, y, 32), method)
        return out.select("x", "y", rounded(F.col("z")).alias("z"))
