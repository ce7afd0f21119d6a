"""Scalar functions on text, arrays, JSON, time and numbers, as Columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(n: Column, digits: int = 2) -> Column:
    """A rounded number as Python prints a float: at least one decimal, no trailing zeros beyond it."""
    fixed = F.regexp_replace(F.format_string(f"%.{digits}f", F.round(n.cast("double"), digits)), r"0+$", "")
    return F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def tags_to_array(tags: Column) -> Column:
    return F.filter(F.split(F.coalesce(tags, F.lit("")), " "), lambda t: t != "")


def array_to_tags(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.trim(t)), " ")


def lenient_tags(text: Column) -> Column:
    """A JSON list of strings; an empty array for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def download_name(name: Column, asset: Column) -> Column:
    """A file name: blanks and slashes become dashes, other signs go, then double dashes after the asset is added."""
    base = F.regexp_replace(F.regexp_replace(name, "[ /]", "-"), "[^0-9a-zA-Z-_]", "")
    return F.regexp_replace(F.concat(base, F.lit("-"), asset), "--+", "-")


def input_name(text: Column, extension: str = "") -> Column:
    """User text as a file name: blanks go, signs other than letters, digits, dash and underscore too."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[^0-9a-zA-Z-_]", ""), F.lit(extension))


def short_id(n: Column) -> Column:
    """Base 36 with the alphabet a-z0-9."""
    plain, own = string.digits + string.ascii_lowercase, string.ascii_lowercase + string.digits
    return F.translate(F.lower(F.conv(n.cast("string"), 10, 36)), plain, own)


def is_short_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def is_slug(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False))


def duration(ms: Column) -> Column:
    """HH:MM:SS; seconds rounded half to even, with carry; dashes for unknown (0, -1)."""
    h = F.floor(ms / 3_600_000)
    m = F.floor((ms - h * 3_600_000) / 60_000)
    s = F.bround((ms - h * 3_600_000 - m * 60_000) / 1000).cast("bigint")
    total = h * 3600 + m * 60 + s  # carries by itself
    pad = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    shown = F.concat_ws(":", pad(F.floor(total / 3600)), pad(F.floor(total / 60) % 60), pad(total % 60))
    return F.when(ms.isin(0, -1), F.lit("-- : -- : --")).otherwise(shown)


def disk_size(mb: Column) -> Column:
    k = 1000.0
    return (
        F.when(mb <= k**2, F.concat(_text(mb / k), F.lit(" GB")))
        .when(mb <= k**3, F.concat(_text(mb / k**2), F.lit(" TB")))
        .otherwise(F.concat(_text(mb / k**3), F.lit(" PB")))
    )


def bytes_label(n: Column, digits: int = 2) -> Column:
    """Bytes with a decimal prefix; comparisons, not logarithms, choose it."""
    out = F.when(n == 0, F.lit("0 bytes")).when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], 1):
        value = F.regexp_replace(F.format_string(f"%.{digits}f", F.round(n / 1000.0**i, digits)), r"\.?0+$", "")
        out = out.when(n < 1000 ** (i + 1), F.concat(value, F.lit(f" {unit}")))
    return out


def percentage(num: Column, den: Column, most: float | None = None) -> Column:
    share = F.greatest(F.try_divide(num, den) * 100, F.lit(0.0))
    return F.when(den == 0, F.lit(100.0)).otherwise(share if most is None else F.least(share, F.lit(float(most))))


def grace_label(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    say = lambda n, unit: F.concat(F.lit("in "), F.floor(n).cast("string"), F.lit(f" {unit}"))
    return F.when(s >= 172_800, say(s / 86_400, "days")).when(s >= 7_200, say(s / 3_600, "hours")).when(s > 1, say(s / 60, "minutes")).otherwise(F.lit("very soon"))


def version_number(text: Column) -> Column:
    """major.minor.build as one integer; further parts are ignored, -1 if a counted part isn't a number."""
    parts = F.split(text, r"\.")
    value = lambda i: F.when(F.size(parts) > i, F.get(parts, F.lit(i)).try_cast("bigint")).otherwise(F.lit(0))
    total = value(0) * 100_000 + value(1) * 100 + value(2)
    ok = F.forall(F.transform(parts, lambda p: p.rlike(r"^\s*[+-]?\d+\s*$")), lambda x: x)
    return F.when(ok, total).otherwise(F.lit(-1))


def decimal_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60.0 + s / 3600.0
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def dataset_url(url: Column) -> dict[str, Column]:
    """server, organization, dataset of a dataset address; the scheme may ask for an unsafe connection, ``/r/`` may precede the path."""
    found = lambda i: F.regexp_extract(url, r"^(ddb\+unsafe|ddb|https?)://([^/]+)/(?:r/)?([^/?#]+)/([^/?#]+)", i)
    scheme = F.when(found(1).isin("ddb+unsafe", "http"), "http://").otherwise("https://")
    ok = found(2) != ""
    return {"server": F.when(ok, F.concat(scheme, found(2))), "organization": F.when(ok, found(3)), "dataset": F.when(ok, found(4))}


def options_map(options: Column) -> Column:
    """name -> value of an array of (name, value); of several the last counts."""
    unique = F.filter(
        F.transform(options, lambda o, i: F.struct(o["name"].alias("name"), o["value"].alias("value"), F.exists(F.slice(options, i + 2, F.greatest(F.size(options), F.lit(1))), lambda p: p["name"] == o["name"]).alias("later"))),
        lambda o: ~o["later"],
    )
    return F.map_from_entries(F.transform(unique, lambda o: F.struct(o["name"], o["value"])))


def without_option(options: Column, name: str) -> Column:
    return F.filter(options, lambda o: o["name"] != name)


def option_value(options: Column, name: str) -> Column:
    return F.try_element_at(F.filter(options, lambda o: o["name"] == name), F.lit(1))["value"]


def merged_json(old: Column, new: Column, protected: tuple[str, ...] = ("view", "pointclouds", "settings")) -> Column:
    """Two string maps merged, the new one winning; protected keys of either are left out."""
    keep = lambda m: F.map_filter(m, lambda k, v: ~k.isin(*protected))
    old, new = keep(old), keep(new)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def ground_control(line: Column) -> Column:
    """A control point line as a struct (x, y, z, px, py, filename, extras); null with fewer than six entries or bad numbers."""
    p = F.split(F.trim(line), r"\s+")
    number = lambda i: F.get(p, F.lit(i)).try_cast("double")
    out = F.struct(
        *(number(i).alias(n) for i, n in enumerate(("x", "y", "z", "px", "py"))),
        F.get(p, F.lit(5)).alias("filename"),
        F.array_join(F.slice(p, 7, F.greatest(F.size(p) - 6, F.lit(0))), " ").alias("extras"),
    )
    ok = (F.size(p) >= 6) & ~F.trim(line).startswith("#")
    for i in range(5):
        ok = ok & number(i).isNotNull()
    return F.when(ok, out)


def ground_control_problem(line: Column) -> Column:
    """What is wrong with a control point line, or null."""
    p = F.split(F.trim(line), r"\s+")
    out = F.when(F.size(p) < 6, F.lit("too few entries"))
    for i, n in enumerate(("x", "y", "z", "px", "py")):
        out = out.when(F.get(p, F.lit(i)).try_cast("double").isNull(), F.lit(f"{n} is not a number"))
    return out


def namespaced(namespace: str, key: Column) -> Column:
    return F.concat(F.lit(f"{namespace}::"), key)


def map_layers(assets: Column) -> Column:
    """Map layers that a task's assets allow; an orthophoto is shown as plant health too."""
    has = lambda a: F.array_contains(assets, a)
    layers = F.array(
        F.when(has("orthophoto.tif"), "orthophoto"), F.when(has("orthophoto.tif"), "plant"), F.when(has("dsm.tif"), "dsm"), F.when(has("dtm.tif"), "dtm")
    )
    return F.array_compact(layers)


def tile_url(task_id: Column, layer: Column, params: dict[str, Column]) -> Column:
    """Path of a task's tiles with those of the five known parameters that are given."""
    known = ("formula", "bands", "rescale", "color_map", "hillshade")
    query = [F.when(params[k].isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(params[k]))) for k in known if k in params]
    base = F.concat(F.lit("/api/tasks/"), task_id, F.lit("/"), layer, F.lit("/tiles.json"))
    text = F.concat_ws("&", *query) if query else F.lit("")
    return F.when(text == "", base).otherwise(F.concat(base, F.lit("?"), text))


def mapped_file(name: Column) -> Column:
    return F.when(F.lower(name).rlike(r"gcp_list.*\.txt$"), F.lit("gcp_list.txt")).otherwise(name)


def progress(info: Column, downloading: Column) -> Column:
    """Processing counts for 85 %, downloading for the 10 % after it."""
    return info / 100 * 0.85 + downloading * 0.1


def resize_ratio(width: Column, height: Column, target: int) -> Column:
    """No enlarging."""
    side = F.greatest(width, height)
    return F.when(side < target, F.lit(1.0)).otherwise(F.try_divide(F.lit(float(target)), side))


def resized(side: Column, ratio: Column) -> Column:
    return F.greatest(F.ceil(side * ratio), F.lit(1))


def staggered(value: Column, buffer: int, cluster: int) -> Column:
    """The next sequence start: buffer added, rounded up to a multiple of it, and the cluster's own place."""
    return (F.ceil((value + buffer) / buffer) * buffer + cluster - 1).cast("bigint")


def reductions(size: Column, most: float, shrink: float = 2.6) -> Column:
    """How often a model of this size must be halved in resolution (each time by ``shrink`` in size) to fit."""
    return F.when(size <= most, F.lit(0)).otherwise(F.ceil(F.log(size / most) / F.log(F.lit(shrink)) - 1e-9)).cast("int")


def control_errors(ex: Column, ey: Column, ez: Column) -> tuple[Column, Column]:
    """Horizontal and vertical error of a control point, to three decimals."""
    return F.round(F.abs(F.greatest(ex, ey)), 3), F.round(F.abs(ez), 3)


def light(azimuth: float, altitude: float) -> tuple[float, float, float]:
    """Unit vector to the light."""
    import math

    a, h = math.radians(90 - azimuth), math.radians(altitude)
    return math.cos(a) * math.cos(h), math.sin(a) * math.cos(h), math.sin(h)


def light_of(azimuth: Column, altitude: Column) -> tuple[Column, Column, Column]:
    """light as Columns."""
    a, h = F.radians(90 - azimuth), F.radians(altitude)
    return F.cos(a) * F.cos(h), F.sin(a) * F.cos(h), F.sin(h)


def image_thumbnail(w: Column, h: Column, center_x: Column, center_y: Column, zoom: Column, size: Column) -> Column:
    """Of an image's view: left, top (of the part around the centre), off_x, off_y (what the zoom cuts off), scale and size.

    The centre is given in shares of the image; each further zoom level doubles.
    No view is larger than the image's longer side.
    """
    scale = F.pow(F.lit(2.0), zoom - 1)
    return F.struct(
        (w * (center_x - 0.5)).alias("left"), (h * (center_y - 0.5)).alias("top"),
        (w / 2.0 - w / scale / 2.0).alias("off_x"), (h / 2.0 - h / scale / 2.0).alias("off_y"),
        scale.alias("scale"), F.least(F.greatest(w, h), size).cast("bigint").alias("size"),
    )


def drawn_point(x: Column, y: Column, radius: Column, w: Column, h: Column, center_x: Column, center_y: Column, zoom: Column) -> tuple[Column, Column, Column]:
    """Where a point, in shares of the image, lies in its view before it is shrunk, and its radius (in hundredths of the longer side)."""
    view = image_thumbnail(w, h, center_x, center_y, zoom, F.lit(1))
    k = view["scale"]
    return (x + 0.5 - center_x) * w * k - view["off_x"] * k, (y + 0.5 - center_y) * h * k - view["off_y"] * k, radius * F.greatest(w, h) / 100.0
