"""Tables that cut a lineage: written to the folder that driver and executors share, and removed when they are done with."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "skyquarry-checkpoints")
    return found.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/skyquarry-{uuid.uuid4()}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside let go of their shuffle files at once."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this module, through the file system that it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str | None = None, by: tuple[str, ...] = ()) -> str:
    """The path of df's rows as a table, in folders by the columns ``by`` if there are any."""
    spark = df.sparkSession
    path = path or fresh_path(spark)
    with tidy(spark):
        out = df.select("*").write  # a plan made under this setting
        (out.partitionBy(*by) if by else out).parquet(path)
    return path


def kept(df: DataFrame, replaces: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """df, cut by a table.  A table has its true size, where a checkpoint would hand on guesses that joins multiply each round.

    replaces: tables made by this function that nothing reads once this one is
    written; they are removed, so a loop holds a round's tables only.
    """
    spark = df.sparkSession
    out = spark.read.schema(df.schema).parquet(path := written(df))
    out._kept_at = path
    for old in replaces if isinstance(replaces, list) else [replaces] if replaces is not None else []:
        if at := getattr(old, "_kept_at", None):
            removed(spark, at)
    return out
