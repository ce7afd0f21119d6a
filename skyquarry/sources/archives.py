"""Zip archives as relations: members in, archives out, one archive in memory at a time."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "archive string, member string, size bigint, content binary, error string"
#: Members are handed on in batches, cut after the archive that exceeds either.
OUTPUT_BYTES, OUTPUT_ROWS = 8 << 20, 10_000


def archived(files: DataFrame) -> DataFrame:
    """(archive, content) of files(archive, member, content): members in name order, of equal names the first content.

    Null archives and members are left out; null content is an empty member.  The
    zip holds no clock, so a task run again writes the same bytes.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zips = []
            for files in batch["files"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for f in files.as_py():
                        z.writestr(zipfile.ZipInfo(f["member"], (1980, 1, 1, 0, 0, 0)), f["content"], zipfile.ZIP_DEFLATED)
                zips.append(buffer.getvalue())
            yield pa.RecordBatch.from_pydict({"archive": batch["archive"], "content": pa.array(zips, pa.binary())})

    rows = files.where("archive is not null and member is not null").groupBy("archive", "member").agg(F.min(F.coalesce("content", F.lit(b""))).alias("content"))
    rows = rows.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("member", "content"))).alias("files"))
    return rows.mapInArrow(pack, "archive string, content binary")


def members(archives: DataFrame) -> DataFrame:
    """(archive, member, size, content, error) of archives(archive, content), folders left out.

    A file that is no readable zip, or a member whose checksum fails, is one row
    with an error and no content, so a caller can fetch it again.
    """

    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for name, raw in zip(batch["archive"], batch["content"], strict=True):
                name = name.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py() or b"")) as z:
                        for m in z.infolist():
                            if m.is_dir():
                                continue
                            try:
                                rows.append((name, m.filename, m.file_size, z.read(m), None))
                                size += m.file_size
                            except (zipfile.BadZipFile, OSError, EOFError, RuntimeError) as e:
                                rows.append((name, m.filename, m.file_size, None, str(e)))
                except zipfile.BadZipFile as e:
                    rows.append((name, None, None, None, str(e)))
                if size > OUTPUT_BYTES or len(rows) > OUTPUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("archive", "content").mapInArrow(unpack, MEMBERS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives under a path that Spark reads (file://, hdfs://, ...): (archive, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("archive"), "content")


def imported(archives: DataFrame) -> DataFrame:
    """members with the reason why one may not be unpacked: it leaves its folder, or can't be read."""
    return members(archives).withColumn("refused", F.coalesce(F.col("error"), F.when(~stays_inside(F.concat(F.lit("/import/"), F.col("member")), F.lit("/import")), F.lit("leaves its folder"))))


def normal_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts; what climbs above the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, empty, step), "/"))


def stays_inside(path: Column, folder: Column) -> Column:
    """Does a path lie in a folder, or is it that folder, once both are normal? Whole names count: /media2 isn't in /media."""
    own, home = normal_path(path), normal_path(folder)
    return F.coalesce((own == home) | F.startswith(own, F.when(home == "/", home).otherwise(F.concat(home, F.lit("/")))), F.lit(False))
