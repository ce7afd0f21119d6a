"""Shapefiles and DXF: fixed binary records and their index, written by partition and read by ranges of records.

A large layer is a folder of shapefiles, one a partition, as a file's records and
index must lie in one place; readers take the folder.
"""

from __future__ import annotations

import struct
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.sources.geotiff import _opened, _uri, fs

#: Kinds of shapes.
NULL, POINT, LINE, POLYGON = 0, 1, 3, 5
KINDS = {POINT: "point", LINE: "line", POLYGON: "polygon"}
#: Records of a partition when reading.
RANGE = 4096
#: Rows that are Python objects at a time when writing.
PIECE = 256


def record(kind: int, parts: list[list[tuple[float, float]]]) -> bytes:
    """A shape's content; no parts: the null shape."""
    points = np.array([p for part in parts for p in part], "<f8").reshape(-1, 2)
    if not len(points):
        return struct.pack("<i", NULL)
    if kind == POINT:
        return struct.pack("<i", POINT) + points[:1].tobytes()
    firsts = np.cumsum([0, *map(len, parts[:-1])]).astype("<i4")
    box = struct.pack("<4d", *points.min(0), *points.max(0))
    return struct.pack("<i", kind) + box + struct.pack("<2i", len(parts), len(points)) + firsts.tobytes() + points.tobytes()


def parts_of(content: bytes) -> tuple[int, list[list[tuple[float, float]]]]:
    kind = struct.unpack_from("<i", content)[0]
    if kind == NULL:
        return kind, []
    flat = kind % 10 if kind < 30 else kind  # shapes with heights or measures have these after the points
    if flat == POINT:
        return flat, [[struct.unpack_from("<2d", content, 4)]]
    if flat not in (LINE, POLYGON):
        raise ValueError(f"shapes of kind {kind} are not supported: points, lines and polygons are")
    n, m = struct.unpack_from("<2i", content, 36)
    firsts = [*np.frombuffer(content, "<i4", n, 44).tolist(), m]
    points = list(map(tuple, np.frombuffer(content, "<f8", 2 * m, 44 + 4 * n).reshape(-1, 2).tolist()))
    return flat, [points[i:j] for i, j in zip(firsts, firsts[1:], strict=False)]


def _header(words: int, kind: int, box: tuple[float, float, float, float]) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)


_WIDTH = {"text": 254, "bigint": 20, "double": 24}


def _table_head(n: int, columns: list[tuple[str, str]]) -> bytes:
    head = b"".join(struct.pack("<11sc4xBB14x", c.encode()[:10], b"C" if k == "text" else b"N", _WIDTH[k], 15 if k == "double" else 0) for c, k in columns)
    size = 1 + sum(_WIDTH[k] for _, k in columns)
    return struct.pack("<B3BIHH20x", 3, 124, 1, 1, n, 32 + len(head) + 1, size) + head + b"\r"


def _table_row(r: dict, columns: list[tuple[str, str]]) -> bytes:
    cells = [b" "]
    for n, k in columns:
        v = r[n]
        raw = b"" if v is None else str(v).encode() if k == "text" else (b"%d" % v if k == "bigint" else b"%.15e" % v)
        raw = raw[:254].decode(errors="ignore").encode() if k == "text" else raw
        cells.append(raw.ljust(_WIDTH[k]) if k == "text" else raw.rjust(_WIDTH[k]))
    return b"".join(cells)


def table(rows: list[dict], columns: list[tuple[str, str]]) -> bytes:
    """The attributes: numbers as text of 24 characters, texts of up to 254 bytes (longer ones are cut by the format)."""
    return _table_head(len(rows), columns) + b"".join(_table_row(r, columns) for r in rows) + b"\x1a"


def fields_of(raw: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, where the first begins, a record's size, and (name, kind, offset, width) of the columns."""
    n, first, size = struct.unpack_from("<IHH", raw, 4)
    out, at, offset = [], 32, 1
    while raw[at] != 13:
        name, kind, width, decimals = struct.unpack_from("<11sc4xBB", raw, at)
        out.append((name.split(b"\0")[0].decode(), "text" if kind not in (b"N", b"F") else "double" if decimals or kind == b"F" else "bigint", offset, width))
        at, offset = at + 32, offset + width
    return n, first, size, out


def _saved(path: str, kind: int, columns: list[tuple[str, str]]):
    """Records go to files of the task's own as they come, as the headers before them hold sizes; so a partition is never whole in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        with tempfile.TemporaryFile() as shp, tempfile.TemporaryFile() as shx, tempfile.TemporaryFile() as dbf:
            n, at, box = 0, 50, None
            for b in batches:
                for i in range(0, b.num_rows, PIECE):
                    for r in b.slice(i, PIECE).to_pylist():
                        parts = [[(p["x"], p["y"]) for p in part] for part in (r["parts"] or []) if part]
                        content = record(kind, parts)
                        n += 1
                        shx.write(struct.pack(">2i", at, len(content) // 2))
                        shp.write(struct.pack(">2i", n, len(content) // 2) + content)
                        dbf.write(_table_row(r, columns))
                        at += 4 + len(content) // 2
                        points = [p for part in parts for p in part]
                        if points:
                            xs, ys = zip(*points, strict=True)
                            own = (min(xs), min(ys), max(xs), max(ys))
                            box = own if box is None else (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
            if not n:
                return
            dbf.write(b"\x1a")
            system, folder = _opened(path)
            system.create_dir(folder, recursive=True)
            name, whole = f"{folder}/part-{TaskContext.get().partitionId():05d}", box or (0.0,) * 4
            files = {".shp": (_header(at, kind, whole), shp), ".shx": (_header(50 + 4 * n, kind, whole), shx), ".dbf": (_table_head(n, columns), dbf)}
            for end, (head, body) in files.items():
                body.seek(0)
                with system.open_output_stream(own := f"{name}{end}.{TaskContext.get().taskAttemptId()}.tmp") as out:
                    out.write(head)
                    while block := body.read(1 << 20):
                        out.write(block)
                system.move(own, f"{name}{end}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([n], pa.int64())})

    return run


def write_shapefile(shapes: DataFrame, path: str, kind: int = LINE) -> int:
    """shapes(parts, attributes) as a folder of shapefiles, one a partition (so a partition's rows should be a file's worth); the number of shapes.

    parts: lists of points (structs x, y); null or empty is the null shape.  Numbers
    become bigint or double attributes, all else text; names have ten bytes at most.
    """
    types = {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "tinyint": "bigint", "double": "double", "float": "double"}
    columns = [(c, types.get(t, "text")) for c, t in shapes.dtypes if c != "parts"]
    if len({c.encode()[:10].lower() for c, _ in columns}) < len(columns):
        raise ValueError("attributes' names must differ in their first ten bytes")
    rows = shapes.select("parts", *(F.col(c) if k != "text" else F.col(c).cast("string").alias(c) for c, k in columns))
    return rows.mapInArrow(_saved(path, kind, columns), "file string, n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def _stems(path: str) -> list[str]:
    system, at = _opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(i.path[:-4] for i in found if i.path.lower().endswith(".shp"))


def _loaded(path: str, columns: list[tuple[str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, first, n in b.itertuples(index=False):
                system, _ = _opened(path)
                with system.open_input_file(f"{stem}.shx") as f:
                    f.seek(100 + 8 * int(first))
                    index = np.frombuffer(f.read(8 * int(n)), ">i4").reshape(-1, 2) * 2
                out: dict[str, list] = {"parts": [], "kind": []} | {c: [] for c, _ in columns}
                with system.open_input_file(f"{stem}.shp") as f:
                    f.seek(int(index[0, 0]))
                    raw = f.read(int(index[-1, 0] + 8 + index[-1, 1] - index[0, 0]))
                for at, size in index.tolist():
                    kind, parts = parts_of(raw[at - index[0, 0] + 8 : at - index[0, 0] + 8 + size])
                    out["parts"].append([[{"x": x, "y": y} for x, y in p] for p in parts])
                    out["kind"].append(KINDS.get(kind))
                with system.open_input_file(f"{stem}.dbf") as f:
                    head = f.read(32)
                    head += f.read(struct.unpack_from("<H", head, 8)[0] - 32)
                    _, start, size, fields = fields_of(head)
                    f.seek(start + size * int(first))
                    rows = f.read(size * int(n))
                have = {name: (k, o, w) for name, k, o, w in fields}
                for c, k in columns:
                    kind_, offset, width = have.get(c, (k, 0, 0))
                    for i in range(int(n)):
                        cell = rows[i * size + offset : i * size + offset + width].decode("utf-8", "replace")
                        out[c].append((cell.rstrip() or None) if k == "text" else None if not cell.strip() else int(cell) if k == "bigint" else float(cell))
                yield pd.DataFrame({c: pd.Series(v, dtype="Int64" if dict(columns).get(c) == "bigint" else object) for c, v in out.items()})

    return run


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """parts, kind and attributes of a shapefile or a folder of them: a task reads a range of records through the index.

    The first file's attributes are taken; the null shape has no parts.
    """
    ranges, columns = [], None
    for stem in _stems(path):
        system, _ = _opened(path)
        n = (system.get_file_info(f"{stem}.shx").size - 100) // 8
        if columns is None:
            with system.open_input_file(f"{stem}.dbf") as f:
                head = f.read(32)
                columns = [(c, k) for c, k, *_ in fields_of(head + f.read(struct.unpack_from("<H", head, 8)[0] - 32))[3]]
        ranges += [(stem, i, min(RANGE, n - i)) for i in range(0, n, RANGE)]
    schema = "parts array<array<struct<x:double,y:double>>>, kind string" + "".join(f", `{c}` {'string' if k == 'text' else k}" for c, k in columns or [])
    if not ranges:
        return spark.createDataFrame([], schema)
    tasks = spark.createDataFrame(ranges, "stem string, first bigint, n bigint").repartition(min(len(ranges), 4 * spark.sparkContext.defaultParallelism), "stem", "first")
    return tasks.mapInPandas(_loaded(path, columns), schema)


def zipped(spark: SparkSession, path: str, out: str) -> str:
    """One shapefile of a folder as the zip that map clients load; its files are streamed."""
    stems = _stems(path)
    if len(stems) != 1:
        raise ValueError(f"{len(stems)} shapefiles in {path}: a zip has one")
    system, _ = _opened(path)
    with _opened(out)[0].open_output_stream(_opened(out)[1]) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for end in (".shp", ".shx", ".dbf"):
            with system.open_input_stream(stems[0] + end) as f, archive.open("layer" + end, "w") as entry:
                while block := f.read(1 << 20):
                    entry.write(block)
    return out


def overlay(spark: SparkSession, path: str, folder: str, most: int = 5_000_000) -> DataFrame:
    """The shapes of an uploaded zip of at most ``most`` bytes: unpacked into ``folder``, then read like any other."""
    system, at = _opened(path)
    if system.get_file_info(at).size > most:
        raise ValueError(f"the upload is larger than {most} bytes")
    target, to = _opened(folder)
    target.create_dir(to, recursive=True)
    with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
        for entry in archive.infolist():
            name = entry.filename.rsplit("/", 1)[-1]
            if name.lower().endswith((".shp", ".shx", ".dbf")):
                with archive.open(entry) as f, target.open_output_stream(f"{to}/{name}") as out:
                    while block := f.read(1 << 20):
                        out.write(block)
    return read_shapefile(spark, folder)


def dxf_lines(shapes: DataFrame, layer: str = "0", elevation: str | None = None) -> DataFrame:
    """(value) the lines of a DXF drawing's entities, one row a polyline, native text; see write_dxf."""
    group = lambda code, v: F.concat(F.lit(f"{code}\n"), v)
    z = F.col(elevation).cast("double").cast("string") if elevation else F.lit("0.0")
    points = lambda part: F.array_join(F.transform(part, lambda p: F.concat_ws("\n", group(10, p["x"].cast("string")), group(20, p["y"].cast("string")))), "\n")
    rows = shapes.select(F.explode("parts").alias("_part"), *([elevation] if elevation else [])).where(F.size("_part") > 1)
    head = ["0\nLWPOLYLINE\n8\n" + layer + "\n90"]
    return rows.select(F.concat_ws("\n", F.lit(head[0]), F.size("_part").cast("string"), group(38, z), points(F.col("_part"))).alias("value"))


def write_dxf(shapes: DataFrame, path: str, layer: str = "0", elevation: str | None = None) -> None:
    """A drawing as text files in order: the first opens the entities, the last closes them; joined they are one DXF."""
    spark = shapes.sparkSession
    body = dxf_lines(shapes, layer, elevation)
    ends = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    ends("0\nSECTION\n2\nENTITIES").union(body).union(ends("0\nENDSEC\n0\nEOF")).write.text(_uri(path))
