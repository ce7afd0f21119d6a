"""Writers: rasters and point clouds as tables, tiles as images, contours as GeoJSON, dumps by owner."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyquarry.functions.color import rendered
from skyquarry.operators.raster import rescale, to_byte


def export_raster(pixels: DataFrame, path: str, block: int = 512) -> None:
    """Parquet laid out like a tiled raster: rows of a block together and sorted, so window reads skip the rest."""
    rows = pixels.withColumn("block_y", F.floor(F.col("y") / block)).withColumn("block_x", F.floor(F.col("x") / block))
    rows.repartitionByRange("block_y", "block_x").sortWithinPartitions("block_y", "block_x", "y", "x").drop("block_y", "block_x").write.mode("overwrite").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names; under a temporary one on a local master that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = os.path.join(tempfile.gettempdir(), "skyquarry")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4()}"


def write_logs(lines: DataFrame, path: str) -> None:
    """lines(task, at, line) as a table (task, line_no, line): lines are numbered from 0 by ``at``, those without come last.

    A file holds the logs of many tasks, so files are as many as partitions, whatever
    the number of tasks; a log is sorted, never held as a whole.
    """
    order = Window.partitionBy("task").orderBy(F.col("at").asc_nulls_last())
    lines.select("task", (F.row_number().over(order) - 1).cast("bigint").alias("line_no"), "line").write.parquet(path)


def export_points(points: DataFrame, path: str, fmt: str = "csv") -> None:
    """Points as CSV with a header, Parquet, or PLY: the parts of the latter, one after the other, are one ASCII file, its header the first."""
    if fmt not in ("csv", "parquet", "ply"):
        raise ValueError(f"unknown point cloud format {fmt!r}")
    if fmt == "csv":
        points.write.mode("overwrite").csv(path, header=True)
    elif fmt == "parquet":
        points.write.mode("overwrite").parquet(path)
    else:
        kinds = {"double": "double", "float": "float", "int": "int", "smallint": "short", "tinyint": "char"}
        own = points.select(*(F.col(c) if t in kinds else F.col(c).cast("double").alias(c) for c, t in points.dtypes))
        lines = ["ply", "format ascii 1.0", f"element vertex {points.count()}", *(f"property {kinds[t]} {c}" for c, t in own.dtypes), "end_header"]
        head = points.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
        head.union(own.select(F.concat_ws(" ", *own.columns).alias("value"))).write.mode("overwrite").text(path)


def read_points(spark: SparkSession, path: str, fmt: str = "csv", columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points that export_points wrote, as doubles."""
    if fmt == "parquet":
        return spark.read.parquet(path).select(*(F.col(c).cast("double").alias(c) for c in columns))
    if fmt == "csv":
        return spark.read.csv(path, header=True, schema=", ".join(f"{c} double" for c in columns))
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^[-+0-9.]"))  # no line of the header begins so
    return rows.select(*(parts[i].cast("double").alias(c) for i, c in enumerate(columns)))


def geojson_features(lines: DataFrame) -> DataFrame:
    """lines(level, points) as one GeoJSON feature a row."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("points").alias("coordinates"))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("level").alias("properties"), geometry.alias("geometry"))).alias("value"))


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey (h, w), RGB or RGBA (h, w, n) image as PNG."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * channels)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def render_tiles(pixels: DataFrame, size: int = 256, bands: tuple[str, ...] = ("v",)) -> DataFrame:
    """(tile_y, tile_x, image): byte pixels (x, y and one band or three) as PNG tiles with transparent gaps. One tile is in memory at a time."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, size, len(bands) + 1), np.uint8)
        ok = pdf[list(bands)].notna().all(axis=1)
        at = (pdf.loc[ok, "y"].to_numpy() % size, pdf.loc[ok, "x"].to_numpy() % size)
        for i, b in enumerate(bands):
            out[(*at, i)] = pdf.loc[ok, b].to_numpy()
        out[(*at, len(bands))] = 255
        return pd.DataFrame({"tile_y": pdf["tile_y"].iloc[:1], "tile_x": pdf["tile_x"].iloc[:1], "image": [png(out)]})

    rows = pixels.select(F.floor(F.col("y") / size).alias("tile_y"), F.floor(F.col("x") / size).alias("tile_x"), "y", "x", *bands)
    return rows.groupBy("tile_y", "tile_x").applyInPandas(draw, "tile_y bigint, tile_x bigint, image binary")


def map_tiles(pixels: DataFrame, value: Column, low: float, high: float, colours: list[str], shade: Column | None = None, size: int = 256) -> DataFrame:
    """(tile_y, tile_x, image) of one request: an index or band (an expression of the pixels' columns) stretched from low..high, coloured, shaded and drawn."""
    r, g, b = rendered(to_byte(rescale(value, low, high)), colours, shade)
    return render_tiles(pixels.select("x", "y", r.alias("r"), g.alias("g"), b.alias("b")), size, ("r", "g", "b"))


def unpng(raw: bytes) -> np.ndarray:
    """The pixels (h, w, channels) of a PNG that png wrote."""
    w, h, _, kind = struct.unpack(">IIBB", raw[16:26])
    channels, data, at = {0: 1, 4: 2, 2: 3, 6: 4}[kind], b"", 8
    while at < len(raw):
        n, name = struct.unpack(">I4s", raw[at : at + 8])
        data += raw[at + 8 : at + 8 + n] if name == b"IDAT" else b""
        at += n + 12
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].reshape(h, w, channels)


def read_tiles(tiles: DataFrame, bands: tuple[str, ...] = ("v",)) -> DataFrame:
    """(x, y and bands) of the opaque pixels of tiles that render_tiles drew."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ty, tx, raw in zip(batch["tile_y"], batch["tile_x"], batch["image"], strict=True):
                image = unpng(raw)
                y, x = np.nonzero(image[:, :, -1])
                yield pd.DataFrame({"x": x + tx * image.shape[1], "y": y + ty * image.shape[0], **{b: image[y, x, i].astype(np.int32) for i, b in enumerate(bands)}})

    return tiles.select("tile_y", "tile_x", "image").mapInPandas(run, "x bigint, y bigint, " + ", ".join(f"{b} int" for b in bands))


def tile_format(opaque: Column, accepts_webp: Column) -> Column:
    return F.when(opaque, F.lit("jpg")).when(accepts_webp, F.lit("webp")).otherwise(F.lit("png"))


def dump_by_owner(projects: DataFrame, path: str) -> None:
    """JSON lines, a folder for each owner."""
    projects.write.mode("overwrite").partitionBy("owner_id").json(path)


def restore_dump(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def detections(images: DataFrame, model, schema: str) -> DataFrame:
    """Hook for object detection: model(batch of (path, content)) to rows, batch by batch on the executors."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, schema)
