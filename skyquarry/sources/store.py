"""Typed key-value rows: a write sets one of five value columns and leaves the others as they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("int", "float", "bool", "string", "json")


def value_of(rows: DataFrame, namespace: str, key: str, kind: str, user: int | None = None, default=None) -> DataFrame:
    """One row (value): what is stored, or the default; nothing is created by reading."""
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    mine = F.col("user_id").isNull() if user is None else F.col("user_id") == user
    found = rows.where((F.col("key") == f"{namespace}::{key}") & mine)
    return found.agg(F.coalesce(F.first(f"{kind}_value", ignorenulls=True), F.lit(default)).alias("value"))


def set_value(rows: DataFrame, namespace: str, key: str, kind: str, value: Column, user: int | None = None) -> DataFrame:
    """The rows with one value set."""
    full, same = f"{namespace}::{key}", F.col("key") == f"{namespace}::{key}"
    mine = same & (F.col("user_id").isNull() if user is None else F.coalesce(F.col("user_id") == user, F.lit(False)))
    kept, column = rows.where(~mine), f"{kind}_value"
    empty = rows.sparkSession.range(1).select(*(F.lit(full if c == "key" else user if c == "user_id" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    own = rows.where(mine).unionByName(empty)
    merged = own.agg(*(F.first(c, ignorenulls=True).alias(c) for c in rows.columns))
    return kept.unionByName(merged.withColumn(column, value.cast(rows.schema[column].dataType)).select(*rows.columns))


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], now: int, ttl: int = 1800) -> DataFrame:
    """What ``compute`` gave at most ``ttl`` seconds before ``now``, read from a table; computed and kept if there is nothing so new.

    Each computation has a folder of its own (its second), so readers never see half
    of one.
    """
    try:
        kept = spark.read.option("basePath", path).parquet(f"{path}/made=*")
        last = kept.agg(F.max("made").alias("made")).first()["made"]
    except AnalysisException:  # nothing was kept yet
        last = None
    if last is None or not now - ttl < last <= now:
        last = now
        compute().write.mode("overwrite").parquet(f"{path}/made={now}")
    return spark.read.parquet(f"{path}/made={last}")
