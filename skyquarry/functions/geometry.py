"""Plane geometry as Columns: boxes, rings, projections."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to web mercator metres."""
    return F.radians(lon) * RADIUS, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - math.pi / 2)


def affine(col: Column, row: Column, t: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Pixel to map coordinates by (a, b, c, d, e, f)."""
    a, b, c, d, e, f = map(float, t)
    return col * a + row * b + c, col * d + row * e + f


def inverse_affine(t: tuple[float, float, float, float, float, float]) -> tuple[float, float, float, float, float, float]:
    a, b, c, d, e, f = map(float, t)
    k = a * e - b * d
    return e / k, -b / k, (b * f - c * e) / k, -d / k, a / k, (c * d - a * f) / k


def ring_area(ring: Column) -> Column:
    """Area of an array of (x, y) by the shoelace rule."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_length(ring: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def ring_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def clipped(ring: Column, box: Column) -> Column:
    """The ring inside a box struct (x0, y0, x1, y1), cut side after side; null if nothing of any area is left, or an input is null."""
    side = lambda axis, name, sign: F.struct(F.lit(axis).alias("axis"), box[name].cast("double").alias("limit"), F.lit(float(sign)).alias("sign"))
    sides = F.array(side(0, "x0", 1), side(0, "x1", -1), side(1, "y0", 1), side(1, "y1", -1))

    def cut(points: Column, s: Column) -> Column:
        inside = lambda p: s["sign"] * (F.when(s["axis"] == 0, p["x"]).otherwise(p["y"]) - s["limit"])
        following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))

        def kept(p: Column, q: Column) -> Column:
            a, b = inside(p), inside(q)
            k = F.try_divide(a, a - b)
            meet = F.struct((p["x"] + (q["x"] - p["x"]) * k).alias("x"), (p["y"] + (q["y"] - p["y"]) * k).alias("y"))
            return F.array_compact(F.array(F.when(a >= 0, F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.when(((a > 0) & (b < 0)) | ((a < 0) & (b > 0)), meet)))

        return F.flatten(F.zip_with(points, following, kept))

    start = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    left = F.aggregate(sides, start, cut)
    complete = box["x0"].isNotNull() & box["y0"].isNotNull() & box["x1"].isNotNull() & box["y1"].isNotNull()
    return F.when(complete, F.aggregate(F.array(left), F.lit(None).cast("array<struct<x:double,y:double>>"), lambda _, r: F.when((F.size(r) > 2) & (ring_area(r) > 0), r)))


def snapped(x0: Column, y0: Column, x1: Column, y1: Column, degrees: float = 30.0) -> tuple[Column, Column]:
    """The end of a segment turned to the nearest multiple of an angle (halves up), its length kept."""
    step = math.radians(degrees)
    dx, dy = x1 - x0, y1 - y0
    angle, length = F.floor(F.atan2(dy, dx) / step + 0.5) * step, F.sqrt(dx * dx + dy * dy)
    return x0 + F.cos(angle) * length, y0 + F.sin(angle) * length


def buffered(x0: Column, y0: Column, x1: Column, y1: Column, d: float) -> tuple[Column, Column, Column, Column]:
    return x0 - d, y0 - d, x1 + d, y1 + d


def epsg_of(wkt: str) -> int | None:
    """The code of the outermost system of a WKT text; of a compound one, its horizontal part's."""
    text = wkt.strip()
    if text.upper().startswith("COMPD_CS") or text.upper().startswith("COMPOUNDCRS"):
        inner = re.search(r"(PROJCS|PROJCRS|GEOGCS|GEOGCRS)\s*\[", text, re.I)
        text = text[inner.start() :] if inner else text
        depth = 0
        for i, ch in enumerate(text):
            depth += (ch == "[") - (ch == "]")
            if ch == "]" and depth == 0:
                text = text[: i + 1]
                break
    found = re.findall(r'(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?', text, re.I)
    return int(found[-1]) if found else None


def geojson_ring(text: Column) -> Column:
    """The outer ring of a GeoJSON polygon, bare or as a feature."""
    geometry = "type string, coordinates array<array<array<double>>>"
    bare = F.from_json(text, geometry)
    feature = F.from_json(text, f"geometry struct<{geometry.replace(' string', ':string').replace('coordinates ', 'coordinates:')}>")["geometry"]
    rings = F.coalesce(bare["coordinates"], feature["coordinates"])
    return F.transform(F.try_element_at(rings, F.lit(1)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def epsg_code(wkt: Column) -> Column:
    """epsg_of as a Column: the last code of the horizontal part; null where there is none."""
    flat = F.regexp_replace(wkt, r"(?is),\s*(VERT_CS|VERTCRS|VERTICALCRS)\s*\[.*$", "")
    codes = F.regexp_extract_all(flat, F.lit(r'(?i)(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?'), F.lit(1))
    return F.try_element_at(codes, F.lit(-1)).cast("int")


#: The ellipsoid of WGS 84 (fixed values), and what follows from it for the transverse Mercator projection: third flattening,
#: radius of the rectifying sphere, and the first coefficients of the series in the third flattening.
SEMI_MAJOR, FLATTENING, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
KRUGER = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]


def to_utm(lon: Column, lat: Column, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """Easting and northing in a zone of the universal transverse Mercator system, to a millimetre within a few degrees of its meridian."""
    zone, south = (x if isinstance(x, Column) else F.lit(x) for x in (zone, south))
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    dl, s = F.radians(lon - (zone * 6 - 183)), F.sin(F.radians(lat))
    half = lambda x: F.log((1 + x) / (1 - x)) * 0.5
    tau = F.sinh(half(s) - half(s * e) * e)
    xi, eta = F.atan2(tau, F.cos(dl)), half(F.sin(dl) / F.sqrt(1 + tau * tau))
    x, y = eta, xi
    for j, a in enumerate(KRUGER, 1):
        x, y = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a, y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    k = UTM_SCALE * RECTIFYING
    return x * k + 500000.0, y * k + F.when(south, 10000000.0).otherwise(0.0)


#: The inverse series to the third order, for the projection and from conformal to geographic latitude.
KRUGER_BACK = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
TO_LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def from_utm(x: Column, y: Column, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a zone of the universal transverse Mercator system."""
    zone, south = (v if isinstance(v, Column) else F.lit(v) for v in (zone, south))
    k = UTM_SCALE * RECTIFYING
    xi, eta = (y - F.when(south, 10000000.0).otherwise(0.0)) / k, (x - 500000.0) / k
    u, v = xi, eta
    for j, b in enumerate(KRUGER_BACK, 1):
        u, v = u - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b, v - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = sum((F.sin(chi * (2 * j)) * d for j, d in enumerate(TO_LATITUDE, 1)), chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183), F.degrees(phi)


def utm_zone(lon: Column) -> Column:
    """The zone of a longitude, 1 to 60."""
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")
