"""Units of length, area, volume and temperature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOOT, US_FOOT = 0.3048, 1200 / 3937


@dataclass(frozen=True)
class Unit:
    name: str
    kind: str
    abbreviation: str
    #: How many of it a metre (square, cubic metre) is; null for temperatures.
    factor: float
    digits: int


#: Names, abbreviations and digits; factors follow from the foot.
UNITS = [
    Unit("acres", "area", "ac", 1 / FOOT**2 / 43560, 5),
    Unit("acres_us", "area", "ac (US)", 1 / US_FOOT**2 / 43560, 5),
    Unit("feet", "length", "ft", 1 / FOOT, 4),
    Unit("feet_us", "length", "ft (US)", 1 / US_FOOT, 4),
    Unit("hectares", "area", "ha", 1e-4, 4),
    Unit("meters", "length", "m", 1.0, 3),
    Unit("kilometers", "length", "km", 1e-3, 5),
    Unit("centimeters", "length", "cm", 100.0, 1),
    Unit("miles", "length", "mi", 1 / FOOT / 5280, 5),
    Unit("miles_us", "length", "mi (US)", 1 / US_FOOT / 5280, 5),
    Unit("sqfeet", "area", "ft²", 1 / FOOT**2, 2),
    Unit("sqfeet_us", "area", "ft² (US)", 1 / US_FOOT**2, 2),
    Unit("sqmeters", "area", "m²", 1.0, 2),
    Unit("sqkilometers", "area", "km²", 1e-6, 5),
    Unit("sqmiles", "area", "mi²", (1 / FOOT / 5280) ** 2, 5),
    Unit("sqmiles_us", "area", "mi² (US)", (1 / US_FOOT / 5280) ** 2, 5),
    Unit("cbmeters", "volume", "m³", 1.0, 4),
    Unit("cbyards", "volume", "yd³", 1 / (3 * FOOT) ** 3, 4),
    Unit("cbyards_us", "volume", "yd³ (US)", 1 / (3 * US_FOOT) ** 3, 4),
    Unit("celsius", "temperature", "°C", 1.0, 1),
    Unit("fahrenheit", "temperature", "°F", 1.8, 1),
]
BY_NAME = {u.name: u for u in UNITS}


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u.name, u.kind, u.abbreviation, u.factor, u.digits) for u in UNITS], "unit string, kind string, abbreviation string, factor double, digits int")


def metres(unit: Column) -> Column:
    """Metres in one of the unit; 1 for unknown ones."""
    return F.when(unit.isin("ft", "foot", "feet"), F.lit(FOOT)).when(unit.isin("US survey foot", "us-ft"), F.lit(US_FOOT)).otherwise(F.lit(1.0))


def length_unit(v: Column, system: str) -> Column:
    if system == "metric":
        return F.when(v < 1, "cm").when(v >= 1000, "km").otherwise("m")
    return F.when(v / FOOT >= 5280, "mi").otherwise("ft")


def area_unit(v: Column, system: str) -> Column:
    if system == "metric":
        return F.when(v >= 1_000_000, "km²").when(v >= 10_000, "ha").otherwise("m²")
    feet = v / (FOOT * FOOT)
    return F.when(feet >= 27_878_400, "mi²").when(feet >= 43_560, "ac").otherwise("ft²")


def convert(v: Column, unit: str) -> Column:
    return fahrenheit(v) if unit == "fahrenheit" else v * F.lit(BY_NAME[unit].factor)


def to_metric(v: Column, unit: str) -> Column:
    return celsius(v) if unit == "fahrenheit" else v / F.lit(BY_NAME[unit].factor)


def fahrenheit(v: Column) -> Column:
    return v * 9 / 5 + 32


def celsius(v: Column) -> Column:
    return (v - 32) * 5 / 9


def label(v: Column, unit: str) -> Column:
    """Rounded, with thousands separators, without trailing zeros, and the unit."""
    u = BY_NAME[unit]
    number = F.regexp_replace(F.format_number(F.round(v, u.digits), u.digits), r"\.?0+$", "")
    return F.concat(number, F.lit(f" {u.abbreviation}"))
