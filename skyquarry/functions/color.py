"""Colours as Columns: hexadecimal, packed integers, hue-saturation-value, palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two discrete palettes.
PALETTES = {
    "discrete_ndvi": ["#AD0028", "#FFAB69", "#FDFEC2", "#77CA6F", "#014729"],
    "better_discrete_ndvi": [
        "#AD0028", "#C5142A", "#E02D2C", "#EF4C3A", "#FE6C4A", "#FF8D5A", "#FFAB69", "#FFC67D", "#FFE093", "#FFEFAB",
        "#FDFEC2", "#EAF7AC", "#D5EF94", "#B9E383", "#9BD873", "#77CA6F", "#53BD6B", "#14AA60", "#009755", "#007E47",
    ],
}


def palettes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in PALETTES.items()], "name string, colours array<string>")


def discrete(value: Column, colours: list[str]) -> Column:
    """The colour of a byte value: as many equal steps over 0..255 as there are colours."""
    at = F.when(value.isNotNull(), F.least(F.floor(value / 256 * len(colours)), F.lit(len(colours) - 1)).cast("int"))  # least skips nulls
    return F.get(F.array(*(F.lit(c) for c in colours)), at)


def colormap(spark: SparkSession, name: str) -> DataFrame:
    """(value, colour) for every byte value."""
    return spark.range(256).select(F.col("id").cast("int").alias("value"), discrete(F.col("id"), PALETTES[name]).alias("colour"))


def hex_to_rgb(text: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of ``#rrggbb`` (the ``#`` may be missing); white for anything else."""
    ok = text.rlike("^#?[0-9A-Fa-f]{6}$")
    digits = F.regexp_replace(text, "#", "")
    return tuple(F.when(ok, F.conv(F.substring(digits, i, 2), 16, 10).cast("int")).otherwise(F.lit(255)) for i in (1, 3, 5))


def to_hex(*channels: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("bigint")), 2, "0") for c in channels)))


def complement(text: Column) -> Column:
    return to_hex(*(F.lit(255) - c for c in hex_to_rgb(text)))


def scale_brightness(text: Column, factor: float) -> Column:
    return to_hex(*(F.least(F.floor(c * factor), F.lit(255)) for c in hex_to_rgb(text)))


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    wide = [c.cast("bigint") for c in (r, g, b, a)]
    return F.shiftleft(wide[0], 24) + F.shiftleft(wide[1], 16) + F.shiftleft(wide[2], 8) + wide[3]


def unpack(v: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("int") for s in (24, 16, 8, 0))


def rgb_to_hs(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue and saturation in [0, 1); of equal largest channels red counts before green before blue."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    h = F.when(hi == lo, F.lit(0.0)).when(r == hi, (g - b) / d).when(g == hi, F.lit(2.0) + (b - r) / d).otherwise(F.lit(4.0) + (r - g) / d) / 6
    return h - F.floor(h), F.when(hi == 0, F.lit(0.0)).otherwise(F.try_divide(hi - lo, hi))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Bytes (truncated) from hue, saturation, value in [0, 1]: six sectors of hue."""
    sector = F.floor(h * 6) % 6
    f = h * 6 - F.floor(h * 6)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    of = {"r": (v, q, p, p, t, v), "g": (t, v, v, q, p, p), "b": (p, p, t, v, v, q)}

    def channel(values):
        out = F.when(sector == 0, values[0])
        for i in range(1, 5):
            out = out.when(sector == i, values[i])
        return F.floor(out.otherwise(values[5]) * 255 + 1e-9).cast("int")

    return tuple(channel(of[c]) for c in "rgb")


def hsv_blend(r: Column, g: Column, b: Column, intensity: Column) -> tuple[Column, Column, Column]:
    """The colour with its value replaced by the intensity."""
    h, s = rgb_to_hs(r, g, b)
    return hsv_to_rgb(h, s, intensity)


def rendered(value: Column, colours: list[str], shade: Column | None = None) -> tuple[Column, Column, Column]:
    """Red, green and blue of a byte value: its colour, with its brightness replaced by a shade of 0 to 1 if there is one; null where the value or the shade is.

    At the hue and saturation of a colour, brightness v gives v times its channels over the largest one.
    """
    at = F.when(value.isNotNull(), F.least(F.floor(value / 256 * len(colours)), F.lit(len(colours) - 1)).cast("int"))  # least skips nulls
    channels = [[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in colours]
    if shade is None:
        return tuple(F.get(F.array(*(F.lit(c[k]) for c in channels)), at) for k in range(3))
    share = lambda k: F.get(F.array(*(F.lit(c[k] / max(c) if max(c) else 1.0) for c in channels)), at)
    return tuple(F.floor(share(k) * shade * 255 + 1e-9).cast("int") for k in range(3))
