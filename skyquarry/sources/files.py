"""Readers of the domain's files: control points, statistics, overlays, logs, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyquarry.functions.scalars import ground_control


def ground_control_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, srs, line_no, x, y, z, px, py, filename, extras): the first line that isn't blank is the reference system; blanks and comments are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = lines.select("path", F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit("")))), lambda x: x != "").alias("l"))
    body = rows.select("path", F.col("l")[0].alias("srs"), F.posexplode("l").alias("line_no", "line")).where("line_no > 0")
    return body.select("path", "srs", "line_no", ground_control(F.col("line")).alias("g")).where("g IS NOT NULL").select("path", "srs", "line_no", "g.*")


STATS = (
    "point_cloud_statistics struct<dense:boolean,stats:struct<statistic:array<struct<count:bigint>>>>, "
    "reconstruction_statistics struct<reconstructed_points_count:bigint,has_gps:boolean,has_gcp:boolean>, "
    "odm_processing_statistics struct<average_gsd:double>, processing_statistics struct<area:double,start_date:string,end_date:string>"
)


def task_statistics(text: Column) -> Column:
    """points, gsd, area, start_date, end_date of a statistics document; the dense cloud's count where there is one."""
    s = F.from_json(text, STATS)
    dense = F.try_element_at(s["point_cloud_statistics"]["stats"]["statistic"], F.lit(1))["count"]
    points = F.when(s["point_cloud_statistics"]["dense"], dense).otherwise(s["reconstruction_statistics"]["reconstructed_points_count"])
    return F.struct(
        points.alias("points"), s["odm_processing_statistics"]["average_gsd"].alias("gsd"), s["processing_statistics"]["area"].alias("area"),
        s["processing_statistics"]["start_date"].alias("start_date"), s["processing_statistics"]["end_date"].alias("end_date"),
    )


def overlay(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of GeoJSON files: (type, coordinates as text, properties as text)."""
    whole = spark.read.text(path, wholetext=True)
    feature = "struct<geometry:struct<type:string,coordinates:string>,properties:string>"
    rows = whole.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    return rows.select(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def console_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of log files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return rows.select("path", F.col("line_no").cast("bigint").alias("line_no"), "line")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(task, line_no, line) of logs that sinks.write_logs wrote."""
    return spark.read.schema("task string, line_no bigint, line string").parquet(path)


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each task's log."""
    order = Window.partitionBy("task").orderBy(F.col("line_no").desc())
    return lines.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= n).drop("_back")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def images(files: DataFrame) -> DataFrame:
    """Those of a listing that are images or control point lists."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.where(name.rlike(r"\.(jpe?g|tiff?|png)$") | name.isin("gcp_list.txt"))


def memory_stats(lines: DataFrame) -> DataFrame:
    """One row (total, free, used) in kB from lines such as ``MemTotal: 16 kB``; free includes buffers and caches."""
    p = F.split(F.regexp_replace("value", ":", ""), r"\s+")
    rows = lines.select(p[0].alias("k"), F.try_element_at(p, F.lit(2)).try_cast("bigint").alias("v"))
    pick = lambda *names: F.coalesce(F.sum(F.when(F.col("k").isin(*names), F.col("v"))), F.lit(0))
    out = rows.agg(pick("MemTotal").alias("total"), pick("MemFree", "Buffers", "Cached").alias("free"))
    return out.withColumn("used", F.col("total") - F.col("free"))


def georeferenced(srs: Column, failed: Column) -> Column:
    """Has a point cloud a reference system? If its summary couldn't be read, yes."""
    return F.when(failed, F.lit(True)).otherwise(F.coalesce(srs != "", F.lit(False)))
