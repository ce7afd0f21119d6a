"""GeoTIFF as a Spark data source: a raster is a folder of tiled files, each with its overviews.

``spark.read.format("geotiff").load(folder)`` gives x, y, b1 .. bn, one row a pixel;
comparisons of x and y skip files and tiles.  ``save`` makes a folder, one file a
square of pixels, so no task or driver holds a raster.  Files lie wherever pyarrow's
file systems reach; headers, predictors and overviews are our own code.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from skyquarry.engine.session import ship

#: Tag numbers of the format, and the sizes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, EXTRA, FORMAT = 322, 323, 324, 325, 338, 339
SUBFILE, SCALE, TIE, GEO_KEYS, METADATA, NODATA = 254, 33550, 33922, 34735, 42112, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
DEFLATE = (8, 32946)
#: Pixels of a side of a tile and of a file. A file's side over a tile's is a power of two.
TILE, FILE = 256, 2048
#: Bytes of a file beyond which its tiles are dealt over several partitions.
SPLIT = 64 << 20
#: Tiles of a partition.
RANGE = 64


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def predicted(a: np.ndarray) -> bytes:
    """A tile's rows as differences: of values for integers, of byte planes for floats."""
    if a.dtype.kind == "f":
        planes = a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(*a.shape, -1).transpose(0, 2, 1).reshape(len(a), -1)
        return np.diff(planes, axis=1, prepend=np.zeros((len(a), 1), np.uint8)).tobytes()
    return np.diff(a, axis=1, prepend=np.zeros((len(a), 1), a.dtype)).astype(a.dtype.newbyteorder("<")).tobytes()


def restored(raw: bytes, dtype: np.dtype, rows: int, cols: int, samples: int, predictor: int) -> np.ndarray:
    """Rows x cols x samples of a tile."""
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(rows, -1, samples).cumsum(1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, samples)
    a = np.frombuffer(raw, dtype).reshape(rows, cols, samples)
    return a.cumsum(1, dtype=dtype.newbyteorder("=")) if predictor == 2 else a


def halved(bands: np.ndarray) -> np.ndarray:
    """Half as many rows and columns: the mean of the (up to four) values there are, nan for none."""
    n, h, w = bands.shape
    even = np.full((n, h + h % 2, w + w % 2), np.nan)
    even[:, :h, :w] = bands
    parts = even.reshape(n, even.shape[1] // 2, 2, even.shape[2] // 2, 2)
    there = (~np.isnan(parts)).sum((2, 4))
    return np.where(there > 0, np.nansum(parts, (2, 4)) / np.maximum(there, 1), np.nan)


@dataclass(frozen=True)
class Georeference:
    """Where pixel (0, 0) begins, the size of a pixel (y downwards) and the reference system."""

    x: float = 0.0
    y: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    epsg: int = 0


def encoded(bands: np.ndarray, x0: int, y0: int, geo: Georeference, dtype: str = "float64", nodata: float | None = None, tile: int = TILE, levels: int = 3) -> bytes:
    """One file: all headers first, then overviews from the smallest, then the pixels; nan becomes nodata."""
    kind = np.dtype(dtype)
    images, level = [bands], 0
    while level < levels and max(images[-1].shape[1:]) > 1:
        images.append(halved(images[-1]))
        level += 1
    blank = np.nan if nodata is None else nodata
    heads, data = [], []
    for k, image in enumerate(images):
        n, h, w = image.shape
        across, down = -(-w // tile), -(-h // tile)
        full = np.full((n, down * tile, across * tile), blank)
        whole = np.where(np.isnan(image), blank, image)
        full[:, :h, :w] = np.rint(whole) if kind.kind in "iu" else whole
        if kind.kind in "iu":
            full = np.nan_to_num(full, nan=0.0).clip(np.iinfo(kind).min, np.iinfo(kind).max)
        cut = full.astype(kind).reshape(n, down, tile, across, tile).transpose(0, 1, 3, 2, 4).reshape(-1, tile, tile)
        packed = [zlib.compress(predicted(t), 6) for t in cut]
        scale = (geo.dx * 2**k, geo.dy * 2**k)
        rgb = n >= 3 and kind == np.uint8
        tags: dict[int, tuple[int, tuple | bytes]] = {
            SUBFILE: (4, (int(k > 0),)), WIDTH: (4, (w,)), HEIGHT: (4, (h,)), BITS: (3, (kind.itemsize * 8,) * n), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (2 if rgb else 1,)),
            SAMPLES: (3, (n,)), PLANAR: (3, (2,)), PREDICTOR: (3, (3 if kind.kind == "f" else 2,)), TILE_WIDTH: (3, (tile,)), TILE_HEIGHT: (3, (tile,)),
            TILE_AT: (4, (0,) * len(packed)), TILE_BYTES: (4, tuple(map(len, packed))), FORMAT: (3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * n),
            SCALE: (12, (*scale, 0.0)), TIE: (12, (0.0, 0.0, 0.0, geo.x + x0 * geo.dx, geo.y - y0 * geo.dy, 0.0)),
            METADATA: (2, f'<GDALMetadata><Item name="X0">{x0}</Item><Item name="Y0">{y0}</Item></GDALMetadata>\0'.encode()),
        }
        if n > (3 if rgb else 1):
            tags[EXTRA] = (3, (2 if rgb else 0,) * (n - (3 if rgb else 1)))
        if geo.epsg:
            tags[GEO_KEYS] = (3, (1, 1, 0, 2, 1024, 0, 1, 2 if geo.epsg == 4326 else 1, 2048 if geo.epsg == 4326 else 3072, 0, 1, geo.epsg))
        if kind.kind == "f" or nodata is not None:
            tags[NODATA] = (2, f"{'nan' if nodata is None else nodata}\0".encode())
        heads.append(tags)
        data.append(packed)
    raw = lambda t, v: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{TYPES[t]}", *v)
    sizes = [2 + 12 * len(t) + 4 + sum(len(b) + len(b) % 2 for b in (raw(*v) for v in t.values()) if len(b) > 4) for t in heads]
    at = 8 + sum(sizes)
    for tags, packed in sorted(zip(heads, data, strict=True), key=lambda p: p[0][WIDTH][1] + p[0][HEIGHT][1]):
        tags[TILE_AT] = (4, tuple(at + sum(map(len, packed[:i])) for i in range(len(packed))))
        at += sum(map(len, packed))
    if at >= 1 << 32:
        raise ValueError("a file of this many pixels and bands is beyond 4 GB: take smaller files")
    out, base = [struct.pack("<2sHI", b"II", 42, 8)], 8
    for k, tags in enumerate(heads):
        entries, more, room = [], b"", base + 2 + 12 * len(tags) + 4
        for tag in sorted(tags):
            kind_, values = tags[tag]
            b = raw(kind_, values)
            entries.append(struct.pack("<HHI", tag, kind_, len(values)) + (b.ljust(4, b"\0") if len(b) <= 4 else struct.pack("<I", room + len(more))))
            more += b"" if len(b) <= 4 else b + b"\0" * (len(b) % 2)
        base += sizes[k]
        out.append(struct.pack("<H", len(tags)) + b"".join(entries) + struct.pack("<I", base if k + 1 < len(heads) else 0) + more)
    for _, packed in sorted(zip(heads, data, strict=True), key=lambda p: p[0][WIDTH][1] + p[0][HEIGHT][1]):
        out += packed
    return b"".join(out)


class Tiff:
    """The headers of a file, either byte order, 32 or 64 bits, tiles or strips."""

    def __init__(self, file):
        self.file = file
        head = self._at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}[head[:2]]
        self.big = struct.unpack(f"{self.order}H", head[2:4])[0] == 43
        at = struct.unpack(f"{self.order}Q", head[8:16])[0] if self.big else struct.unpack(f"{self.order}I", head[4:8])[0]
        self.images: list[dict[int, tuple]] = []
        while at:
            tags, at = self._image(at)
            self.images.append(tags)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _image(self, at: int) -> tuple[dict[int, tuple], int]:
        wide, count = (20, 8) if self.big else (12, 2)
        n = struct.unpack(f"{self.order}{'Q' if self.big else 'H'}", self._at(at, count))[0]
        raw = self._at(at + count, n * wide + (8 if self.big else 4))
        tags = {}
        for k in range(n):
            tag, kind, values = struct.unpack(f"{self.order}HH{'Q' if self.big else 'I'}", raw[k * wide : k * wide + wide - (8 if self.big else 4)])
            if kind not in TYPES:
                continue
            size = struct.calcsize(f"{self.order}{TYPES[kind]}") * values
            own = raw[(k + 1) * wide - (8 if self.big else 4) : (k + 1) * wide]
            b = own[:size] if size <= len(own) else self._at(struct.unpack(f"{self.order}{'Q' if self.big else 'I'}", own)[0], size)
            tags[tag] = (b,) if kind == 2 else struct.unpack(f"{self.order}{values * len(TYPES[kind])}{TYPES[kind][0]}", b)
        return tags, struct.unpack(f"{self.order}{'Q' if self.big else 'I'}", raw[n * wide :])[0]

    def level(self, k: int) -> dict[int, tuple]:
        """The raster, or its k-th overview."""
        found = [t for t in self.images if k == 0 or t.get(SUBFILE, (0,))[0] & 1]
        if k >= len(found) + (k > 0):
            raise ValueError(f"there is no overview {k}")
        return found[k - 1 if k else 0]

    def origin(self) -> tuple[int, int]:
        text = self.images[0].get(METADATA, (b"",))[0].decode(errors="replace")
        at = [re.search(rf'name="{c}0">(-?\d+)<', text) for c in "XY"]
        return (int(at[0][1]), int(at[1][1])) if all(at) else (0, 0)


def _shape(tags: dict[int, tuple]) -> tuple[int, int, int, int]:
    """Width, height, and those of a tile; a strip is a tile as wide as the raster."""
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    return (w, h, tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if TILE_AT in tags else (w, h, w, min(h, tags.get(STRIP_ROWS, (h,))[0]))


def pixels_of(tiff: Tiff, level: int, box: tuple[float, float, float, float], part: tuple[int, int] = (0, 1 << 62)) -> Iterator[pa.RecordBatch]:
    """The pixels of those tiles (by number, in ``part``) that meet the box."""
    tags = tiff.level(level)
    w, h, tw, th = _shape(tags)
    x0, y0 = (v >> level for v in tiff.origin())
    n, planar, predictor = tags.get(SAMPLES, (1,))[0], tags.get(PLANAR, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    dtype = np.dtype(f"{tiff.order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
    ats, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if TILE_AT in tags else (tags[STRIP_AT], tags[STRIP_BYTES])
    how, across, down = tags.get(COMPRESSION, (1,))[0], -(-w // tw), -(-h // th)
    if how != 1 and how not in DEFLATE:
        raise ValueError(f"compression {how} is not supported: none and deflate are")
    blank = tags.get(NODATA, (None,))[0]
    blank = None if blank is None else float(blank.rstrip(b"\0 ") or b"nan")

    def tile(i: int) -> np.ndarray:
        raw = tiff._at(ats[i], sizes[i])
        raw = raw if how == 1 else zlib.decompress(raw)
        samples = n if planar == 1 else 1
        rows = len(raw) // (tw * samples * dtype.itemsize)  # a last strip may be shorter
        return restored(raw, dtype, rows, tw, samples, predictor)

    for k in range(max(0, part[0]), min(across * down, part[1])):
        r, c = divmod(k, across)
        left, top, right, low = x0 + c * tw, y0 + r * th, x0 + min(w, (c + 1) * tw) - 1, y0 + min(h, (r + 1) * th) - 1
        if right < box[0] or left > box[1] or low < box[2] or top > box[3]:
            continue
        planes = [tile(k)] if planar == 1 else [tile(b * across * down + k) for b in range(n)]
        a = np.concatenate(planes, axis=2)[: low - top + 1, : right - left + 1].astype(np.float64)
        gone = np.isnan(a) | (a == blank if blank is not None else False)
        ys, xs = np.mgrid[top : low + 1, left : right + 1]
        columns = {"x": xs.ravel().astype(np.int64), "y": ys.ravel().astype(np.int64)} | {f"b{b + 1}": pa.array(a[:, :, b].ravel(), mask=gone[:, :, b].ravel()) for b in range(n)}
        yield pa.RecordBatch.from_pydict(columns)


@dataclass
class TileRange(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level
        self.box = [float("-inf"), float("inf"), float("-inf"), float("inf")]

    def pushFilters(self, filters):
        """Comparisons of x and y narrow the box; Spark applies them to the rows of the tiles that meet it all the same."""
        for f in filters:
            axis = {("x",): 0, ("y",): 2}.get(getattr(f, "attribute", None))
            if axis is not None and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.box[axis] = max(self.box[axis], f.value + isinstance(f, GreaterThan))
            if axis is not None and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.box[axis + 1] = min(self.box[axis + 1], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[TileRange]:
        """One a file, or a range of tiles of a large one; files of ours say by their name where they lie."""
        out = []
        for info in _files(self.path):
            if at := re.search(r"x(-?\d+)_y(-?\d+)_w(\d+)_h(\d+)\.tif$", info.path):
                x, y, w, h = (int(v) for v in at.groups())
                x, y, w, h = x >> self.level, y >> self.level, -(-w >> self.level), -(-h >> self.level)
                if x + w - 1 < self.box[0] or x > self.box[1] or y + h - 1 < self.box[2] or y > self.box[3]:
                    continue
            tiles = 1 << 62
            if info.size > SPLIT:
                with _opened(self.path)[0].open_input_file(info.path) as f:
                    w, h, tw, th = _shape(Tiff(f).level(self.level))
                tiles = -(-w // tw) * -(-h // th)
            out += [TileRange(info.path, k, k + RANGE) for k in range(0, tiles, RANGE)] if tiles < 1 << 62 else [TileRange(info.path, 0, tiles)]
        return out

    def read(self, partition: TileRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        with _opened(self.path)[0].open_input_file(partition.path) as f:
            yield from pixels_of(Tiff(f), self.level, tuple(self.box), (partition.first, partition.last))


def _files(path: str) -> list[fs.FileInfo]:
    system, at = _opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((i for i in found if i.path.lower().endswith((".tif", ".tiff"))), key=lambda i: i.path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class GeoTiffWriter(DataSourceArrowWriter):
    """Rows come by file (fx, fy) and in no order within; a file is written under another name and then renamed, so a task run twice leaves one."""

    def __init__(self, path: str, options: dict):
        self.path, o = path, options
        self.geo = Georeference(*(float(o.get(k, d)) for k, d in (("originx", 0), ("originy", 0), ("pixelx", 1), ("pixely", 1))), int(o.get("epsg", 0)))
        self.dtype, self.tile, self.side, self.levels = o.get("dtype", "float64"), int(o.get("tile", TILE)), int(o.get("file", FILE)), int(o.get("levels", 3))
        self.nodata = float(o["nodata"]) if "nodata" in o else None

    def _save(self, parts: list[pa.RecordBatch]) -> str:
        table = pa.Table.from_batches(parts)
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        x0, y0 = int(x[0]) // self.side * self.side, int(y[0]) // self.side * self.side
        bands = [c for c in table.column_names if c not in ("x", "y", "fx", "fy")]
        image = np.full((len(bands), int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
        for k, b in enumerate(bands):
            image[k, y - y0, x - x0] = table.column(b).cast(pa.float64()).to_numpy()
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/x{x0}_y{y0}_w{image.shape[2]}_h{image.shape[1]}.tif"
        from pyspark import TaskContext

        with system.open_output_stream(own := f"{name}.{TaskContext.get().taskAttemptId()}.part") as out:
            out.write(encoded(image, x0, y0, self.geo, self.dtype, self.nodata, self.tile, self.levels))
        system.move(own, name)
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held, now, files = [], None, []
        for batch in iterator:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column("fx").to_numpy(), batch.column("fy").to_numpy()])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if held and now != tuple(at[:, i]):
                    files.append(self._save(held))
                    held = []
                now = tuple(at[:, i])
                held.append(batch.slice(i, j - i))
        if held:
            files.append(self._save(held))
        return Written(files)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files:
            return "x bigint, y bigint, b1 double"
        with _opened(self.options["path"])[0].open_input_file(files[0].path) as f:
            n = Tiff(f).images[0].get(SAMPLES, (1,))[0]
        return "x bigint, y bigint, " + ", ".join(f"b{k + 1} double" for k in range(n))

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], int(self.options.get("level", 0)))

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options["path"], {k.lower(): v for k, v in self.options.items()})


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source, and with filters handed down to it."""
    ship(spark).dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_geotiff(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """x, y, b1 .. bn of a file or folder; level k is the k-th overview, with x and y in its own pixels.

    Nodata is null.  A pixel's x and y count from the raster's first pixel in a foreign
    file, and as they were written in a folder of ours.
    """
    return registered(spark).read.format("geotiff").option("level", str(level)).load(_uri(path))


def write_geotiff(pixels: DataFrame, path: str, bands: list[str], file: int = FILE, **options: object) -> None:
    """pixels(x, y, bands) as a folder of files of ``file`` pixels a side; a file's rows meet in one task.

    options: dtype (float64), nodata (nan for floats), tile, levels of overviews,
    originx, originy, pixelx, pixely, epsg.  Nulls, nan and pixels that aren't there
    become nodata (0 where an integer type has none); values beyond an integer type
    are clipped to it.  A pixel that occurs twice has one of its values.
    """
    tile = int(options.get("tile", TILE))
    if file % tile or file >> int(options.get("levels", 3)) < 1 or file % (1 << int(options.get("levels", 3))):
        raise ValueError("a file's side must be a multiple of a tile's and of 2**levels")
    rows = pixels.select(F.col("x").cast("bigint"), F.col("y").cast("bigint"), *(F.col(b).cast("double").alias(f"b{k + 1}") for k, b in enumerate(bands)))
    rows = rows.withColumn("fx", F.floor(F.col("x") / file)).withColumn("fy", F.floor(F.col("y") / file))
    registered(pixels.sparkSession)
    write = rows.repartition("fx", "fy").sortWithinPartitions("fx", "fy").write.format("geotiff").mode("append").option("file", str(file))
    for k, v in options.items():
        write = write.option(k, str(v))
    write.save(_uri(path))
