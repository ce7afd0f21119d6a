"""Band mathematics: an index is a function of Columns, bound to a raster's bands by its band order."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.functions.ieee import NODATA, clean, divide


@dataclass(frozen=True)
class Formula:
    bands: tuple[str, ...]
    make: Callable[..., Column]
    range: tuple[float, float] | None = None
    hidden: bool = False


def _c(x: float) -> Column:
    return F.lit(float(x))


def _share(a: Column, b: Column) -> Column:
    return divide(a - b, a + b)


def _evi(n: Column, r: Column, b: Column) -> Column:
    return _c(2.5) * divide(n - r, n + _c(6) * r - _c(7.5) * b + _c(1))


UNIT = (-1.0, 1.0)

#: Public definitions of the indices; the arguments are bands in the order given.
FORMULAS: dict[str, Formula] = {
    "NDVI": Formula(("N", "R"), _share, UNIT),
    "NDYI": Formula(("G", "B"), _share, UNIT),
    "NDRE": Formula(("N", "Re"), _share, UNIT),
    "NDWI": Formula(("G", "N"), _share, UNIT),
    "NDVI (Blue)": Formula(("N", "B"), _share, UNIT),
    "ENDVI": Formula(("N", "G", "B"), lambda n, g, b: _share(n + g, _c(2) * b)),
    "vNDVI": Formula(("R", "G", "B"), lambda r, g, b: _c(0.5268) * (F.pow(r, _c(-0.1294)) * F.pow(g, _c(0.3389)) * F.pow(b, _c(-0.3118)))),
    "VARI": Formula(("G", "R", "B"), lambda g, r, b: divide(g - r, g + r - b), UNIT),
    "MPRI": Formula(("G", "R"), _share, UNIT),
    "EXG": Formula(("G", "R", "B"), lambda g, r, b: _c(2) * g - (r + b)),
    "BAI": Formula(("R", "N"), lambda r, n: divide(_c(1), (_c(0.1) - r) * (_c(0.1) - r) + (_c(0.06) - n) * (_c(0.06) - n))),
    "GLI": Formula(("G", "R", "B"), lambda g, r, b: divide(_c(2) * g - r - b, _c(2) * g + r + b), UNIT),
    "GNDVI": Formula(("N", "G"), _share, UNIT),
    "GRVI": Formula(("N", "G"), divide),
    "SAVI": Formula(("N", "R"), lambda n, r: divide(_c(1.5) * (n - r), n + r + _c(0.5))),
    "MNLI": Formula(("N", "R"), lambda n, r: divide((n * n - r) * _c(1.5), n * n + r + _c(0.5))),
    "MSR": Formula(("N", "R"), lambda n, r: divide(divide(n, r) - _c(1), F.sqrt(divide(n, r)) + _c(1))),
    "RDVI": Formula(("N", "R"), lambda n, r: divide(n - r, F.sqrt(n + r))),
    "TDVI": Formula(("N", "R"), lambda n, r: divide(_c(1.5) * (n - r), F.sqrt(n * n + r + _c(0.5)))),
    "OSAVI": Formula(("N", "R"), lambda n, r: divide(n - r, n + r + _c(0.16))),
    "LAI": Formula(("N", "R", "B"), lambda n, r, b: _c(3.618) * _evi(n, r, b) - _c(0.118), UNIT),
    "EVI": Formula(("N", "R", "B"), _evi, UNIT),
    "ARVI": Formula(("N", "R", "B"), lambda n, r, b: divide(n - _c(2) * r + b, n + _c(2) * r + b), UNIT),
    "Celsius": Formula(("L",), lambda x: x),
    "Kelvin": Formula(("L",), lambda x: x * _c(100) + _c(27315)),
    "_TESTRB": Formula(("R", "B"), lambda r, b: r + b, (0.0, 1.0), True),
    "_TESTFUNC": Formula(("R", "B"), lambda r, b: r + F.sqrt(b), None, True),
}

#: The camera filters, as band orders.
FILTERS = ["RGB", "RGN", "NGB", "NRG", "NRB", "RGBN", "RGNRe", "GRReN", "RGBNRe", "BGRNRe", "BGRReN", "RGBReN", "RGBNReL", "BGRNReL", "BGRReNL", "RGBNRePL", "L"]
#: Names that band descriptions use.
ALIASES = {"R": ["red", "r"], "G": ["green", "g"], "B": ["blue", "b"], "N": ["nir", "n"], "Re": ["rededge", "re"], "P": ["panchro", "p"], "L": ["lwir", "l"]}
BY_ALIAS = {a: band for band, names in ALIASES.items() for a in names}


def bands_of(order: str) -> list[str]:
    return re.findall("[A-Z][a-z]*", order)


def bind(name: str, order: str | None = "RGB") -> tuple[Callable[[Mapping[int, Column]], Column], Formula, list[int]]:
    """The index as a function of {band position from 1: Column}, and the positions that it reads."""
    if name not in FORMULAS:
        raise ValueError(f"unknown index {name!r}")
    formula, have = FORMULAS[name], bands_of(order or "RGB")
    missing = [b for b in formula.bands if b not in have]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}, which {order} doesn't have")
    at = [have.index(b) + 1 for b in formula.bands]
    return (lambda bands: formula.make(*(bands[i] for i in at))), formula, sorted(set(at))


def index(name: str, bands: Mapping[str, Column], alpha: Column | None = None) -> Column:
    """The cleaned index over named bands; nodata where alpha is 0."""
    value = clean(FORMULAS[name].make(*(bands[b] for b in FORMULAS[name].bands)))
    return value if alpha is None else F.when(alpha != 0, value).otherwise(F.lit(NODATA))


def several(expressions: list[str], bands: Mapping[str, Column]) -> list[Column]:
    """Several indices at once; only the first is cleaned of NaN and infinity."""
    return [index(e, bands) if i == 0 else FORMULAS[e].make(*(bands[b] for b in FORMULAS[e].bands)) for i, e in enumerate(expressions)]


def filters_for(name: str, most: int | None = None) -> list[str]:
    """Camera filters with all bands of an index, of at most so many bands."""
    need = set(FORMULAS[name].bands)
    return [f for f in FILTERS if need <= set(bands_of(f)) and (most is None or len(bands_of(f)) <= most)]


def available(most: int | None = None) -> list[str]:
    """Public indices that some filter of at most so many bands allows."""
    return [k for k, f in FORMULAS.items() if not f.hidden and filters_for(k, most)]


def auto_order(bands: list[tuple[str, str | None]], name: str) -> tuple[str, bool]:
    """Band order read from (name, description) of a raster's bands, one of them alpha; if that is no filter of the index, its first filter, unmatched."""
    allowed = filters_for(name, len(bands) - 1)
    if not allowed:
        raise ValueError(f"no camera filter of {len(bands) - 1} bands has what {name} needs")
    order = "".join(BY_ALIAS.get(d.lower(), "") for n, d in bands if n != "alpha" and d)
    return (order, True) if order in allowed else (allowed[0], False)


def default_index(descriptions: list[str]) -> str:
    """NDVI if red, green and near-infrared are described, VARI otherwise; Celsius for two bands."""
    if len(descriptions) == 2:
        return "Celsius"
    return "NDVI" if {"red", "green", "nir"} <= {d.lower() for d in descriptions} else "VARI"


def catalog(spark: SparkSession) -> DataFrame:
    """Indices as a relation: name, bands, low, high, hidden."""
    rows = [(k, list(f.bands), *(f.range or (None, None)), f.hidden) for k, f in FORMULAS.items()]
    return spark.createDataFrame(rows, "name string, bands array<string>, low double, high double, hidden boolean")


def filter_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, bands_of(f)) for f in FILTERS], "filter string, bands array<string>")


def rgb_positions(interpretations: list[str | None]) -> list[int]:
    """Bands to show: those of red, green, blue; grey (alone or with alpha) three times; else the first three."""
    names = [(x or "").lower() for x in interpretations]
    if all(c in names for c in ("red", "green", "blue")):
        return [names.index(c) + 1 for c in ("red", "green", "blue")]
    return [1, 1, 1] if len([x for x in names if x != "alpha"]) == 1 else [1, 2, 3]


def render_defaults(kind: str, formula: str | None = None) -> dict[str, object]:
    """Rescale and colormap where a request gives none."""
    if kind in ("dsm", "dtm"):
        return {"rescale": (0.0, 1000.0), "color_map": "gray"}
    return {"rescale": UNIT, "color_map": "gray"} if formula else {"rescale": (0.0, 255.0), "color_map": None}


def export_settings(kind: str, fmt: str, formula: str | None = None, bands: str | None = None, rescale=None, color_map=None, hillshade=None) -> dict[str, object]:
    """A checked export request with its defaults."""
    if fmt not in ("gtiff", "gtiff-rgb", "jpg", "png", "kmz"):
        raise ValueError(f"unknown raster format {fmt!r}")
    if (formula is None) != (bands is None):
        raise ValueError("formula and bands go together")
    if formula is not None:
        bind(formula, bands)
    if kind in ("dsm", "dtm") and fmt != "gtiff":
        color_map, hillshade = color_map or "viridis", 6 if hillshade is None else hillshade
    if formula is not None and fmt in ("gtiff-rgb", "jpg", "png", "kmz"):
        rescale = rescale or UNIT
    return {"format": fmt, "formula": formula, "bands": bands, "rescale": None if fmt == "gtiff" else rescale, "color_map": color_map, "hillshade": hillshade}


def needs_no_work(kind: str, fmt: str, **options: object) -> bool:
    """A plain GeoTIFF of the raster as it is: nothing to compute."""
    return fmt == "gtiff" and not any(v not in (None, "") for v in options.values())


def no_work_needed(kind: Column, fmt: Column, *options: Column) -> Column:
    """needs_no_work for a relation of requests: a plain GeoTIFF and no option that is neither null nor empty."""
    idle = fmt == "gtiff"
    for x in options:
        idle = idle & (x.isNull() | (x.cast("string") == ""))
    return idle


def export_colours(kind: Column, fmt: Column, color_map: Column | None = None, hillshade: Column | None = None) -> tuple[Column, Column]:
    """Palette and hillshade of a relation of export requests: elevation as an image gets viridis and a shade of 6 unless asked otherwise."""
    shown = kind.isin("dsm", "dtm") & (fmt != "gtiff")
    asked = lambda x, kind_: F.lit(None).cast(kind_) if x is None else x
    return F.coalesce(asked(color_map, "string"), F.when(shown, F.lit("viridis"))), F.coalesce(asked(hillshade, "int"), F.when(shown, F.lit(6)))


def auto_order_of(descriptions: Column, name: str) -> Column:
    """auto_order for a relation of rasters: struct(bands, matched) from an array of band descriptions, alpha among them.

    bands is null where no camera filter of so many bands has what the index needs.
    """
    fit = [(f, len(bands_of(f))) for f in filters_for(name, max(len(bands_of(f)) for f in FILTERS))]
    allowed = F.filter(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n in fit)), lambda x: x["n"] <= F.size(descriptions) - 1)
    letters = F.create_map(*(F.lit(x) for kv in BY_ALIAS.items() for x in kv))
    named = F.filter(descriptions, lambda d: d.isNotNull() & (d != "alpha"))
    order = F.array_join(F.transform(named, lambda d: F.coalesce(F.try_element_at(letters, F.lower(d)), F.lit(""))), "")
    matched = F.exists(allowed, lambda x: x["f"] == order)
    return F.struct(F.when(matched, order).otherwise(F.get(allowed, F.lit(0))["f"]).alias("bands"), matched.alias("matched"))


def default_index_of(descriptions: Column) -> Column:
    """default_index for a relation of rasters: an array of band descriptions, in any case."""
    low = F.transform(descriptions, lambda d: F.lower(d))
    full = F.size(F.array_intersect(low, F.array(F.lit("red"), F.lit("green"), F.lit("nir")))) == 3
    return F.when(F.size(descriptions) == 2, F.lit("Celsius")).when(full, F.lit("NDVI")).otherwise(F.lit("VARI"))


def letter_of(description: Column) -> Column:
    """The band letter of a description in any case; null for unknown ones."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in BY_ALIAS.items() for x in kv)), F.lower(description))
