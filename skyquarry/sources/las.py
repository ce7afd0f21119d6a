"""LAS point clouds: fixed records of scaled integers, one file a partition, read by ranges of records."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.sources.geotiff import _opened, fs

#: Points of a partition when reading.
RANGE = 1 << 18
#: Where red begins in the records of those formats that have colours, and the fields that all have.
COLOURS = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
HEADER = 227


def record_type(kind: int, size: int) -> np.dtype:
    """The fields of a point that are read, at their places in a record."""
    late = kind >= 6  # later formats widen the flags before the class
    fields = {"x": ("<i4", 0), "y": ("<i4", 4), "z": ("<i4", 8), "intensity": ("<u2", 12), "class": ("u1", 16 if late else 15)}
    if kind in COLOURS:
        fields |= {c: ("<u2", COLOURS[kind] + 2 * k) for k, c in enumerate(("red", "green", "blue"))}
    return np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": size})


def header_of(raw: bytes) -> dict:
    """Where points begin, their format and size, their number, and scales and offsets."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = raw[24], raw[25]
    first = struct.unpack_from("<I", raw, 96)[0]
    kind, size, n = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed points (LAZ) are not supported")
    if (major, minor) >= (1, 4):
        n = struct.unpack_from("<Q", raw, 247)[0] or n
    return {"first": first, "kind": kind, "size": size, "n": n, "scale": struct.unpack_from("<3d", raw, 131), "offset": struct.unpack_from("<3d", raw, 155)}


def _header(points: np.ndarray, kind: int, size: int, scale: tuple, offset: tuple) -> bytes:
    low = [points[c].min() * scale[k] + offset[k] for k, c in enumerate("xyz")]
    high = [points[c].max() * scale[k] + offset[k] for k, c in enumerate("xyz")]
    box = [v for k in range(3) for v in (high[k], low[k])]
    n = len(points)
    return struct.pack("<4sHH16sBB32s32sHHHIIBHI5I3d3d6d", b"LASF", 0, 0, bytes(16), 1, 2, b"", b"skyquarry", 1, 2024, HEADER, HEADER, 0, kind, size, n, n, 0, 0, 0, 0, *scale, *offset, *box)


def _saved(path: str, kind: int, scale: tuple, offset: tuple):
    size = 26 if kind == 2 else 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = []
        for b in batches:
            points = np.zeros(b.num_rows, record_type(kind, size))
            for k, c in enumerate("xyz"):
                points[c] = np.rint((b.column(c).to_numpy() - offset[k]) / scale[k])
            for c in points.dtype.names[3:]:
                points[c] = b.column(c).to_numpy()
            parts.append(points)
        if not sum(map(len, parts)):
            return
        points = np.frombuffer(b"".join(p.tobytes() for p in parts), record_type(kind, size))  # joined as records: concatenate would pack them
        system, folder = _opened(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.las"
        with system.open_output_stream(own := f"{name}.{TaskContext.get().taskAttemptId()}.tmp") as out:
            out.write(_header(points, kind, size, scale, offset))
            out.write(points.tobytes())
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(points)], pa.int64())})

    return run


def write_las(points: DataFrame, path: str, scale: float = 0.001) -> int:
    """points(x, y, z; intensity, class, red, green, blue where there are any) as a folder of LAS 1.2 files, one a partition; the number of points.

    Coordinates are whole multiples of ``scale`` from the cloud's least ones, which one
    aggregate finds; a cloud that is too wide for 32 bits at this scale is an error.
    Points with a null or nan coordinate are left out, other nulls are 0, and other values are
    clipped to their fields.
    """
    have = {c.lower() for c in points.columns}
    kind = 2 if {"red", "green", "blue"} <= have else 0
    extra = {"intensity": 65535, "class": 31} | ({c: 65535 for c in ("red", "green", "blue")} if kind == 2 else {})
    value = lambda c, most: F.least(F.greatest(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), F.lit(0)), F.lit(most)).alias(c) if c in have else F.lit(0).cast("bigint").alias(c)
    rows = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), *(value(c, m) for c, m in extra.items()))
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    ends = rows.agg(*(F.min(c).alias(f"a{c}") for c in "xyz"), *(F.max(c).alias(f"b{c}") for c in "xyz")).first()
    if ends["ax"] is None:
        return 0
    offset = tuple(math.floor(ends[f"a{c}"]) for c in "xyz")
    if max((ends[f"b{c}"] - offset[k]) / scale for k, c in enumerate("xyz")) >= 1 << 31:
        raise ValueError("the cloud is too wide for this scale")
    return rows.mapInArrow(_saved(path, kind, (scale,) * 3, tuple(map(float, offset))), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def _loaded(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _opened(path)[0].open_input_file(r["file"]) as f:
                    h = header_of(f.read(375))
                    f.seek(h["first"] + h["size"] * r["begin"])
                    points = np.frombuffer(f.read(h["size"] * r["n"]), record_type(h["kind"], h["size"]))
                columns = {c: points[c] * h["scale"][k] + h["offset"][k] for k, c in enumerate("xyz")}
                columns |= {c: points[c].astype(np.int32) if c in points.dtype.names else np.zeros(len(points), np.int32) for c in names}
                for i in range(0, len(points), 1 << 16):
                    yield pa.RecordBatch.from_pydict({c: v[i : i + (1 << 16)] for c, v in columns.items()})

    return run


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, intensity, class, red, green, blue of a file or a folder; 0 where a file's format lacks a colour.  A task reads a range of records."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    ranges = []
    for i in sorted((i for i in files if i.path.lower().endswith(".las")), key=lambda i: i.path):
        with system.open_input_file(i.path) as f:
            h = header_of(f.read(375))
        ranges += [(i.path, k, min(RANGE, h["n"] - k)) for k in range(0, h["n"], RANGE)]
    names = ["intensity", "class", "red", "green", "blue"]
    schema = "x double, y double, z double, " + ", ".join(f"`{c}` int" for c in names)
    if not ranges:
        return spark.createDataFrame([], schema)
    tasks = spark.createDataFrame(ranges, "file string, begin bigint, n bigint").repartition(min(len(ranges), 4 * spark.sparkContext.defaultParallelism), "file", "begin")
    return tasks.mapInArrow(_loaded(path, names), schema)
