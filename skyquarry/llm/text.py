"""Vectorised views of text columns, shared by the operators of this subpackage.

Everything works on Arrow buffers: a batch of texts is one byte array plus
offsets, and words, lines and their hashes are found with NumPy over the whole
array.  Word separators are ASCII bytes, which never occur inside a multi-byte
UTF-8 sequence, so byte positions are exact.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Word separators: space and the control bytes 9 to 13.
SEPARATORS = bytes([32, 9, 10, 11, 12, 13])
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a folder of our own on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or os.path.join(tempfile.gettempdir(), "skyquarry-checkpoints"))
    return found or context._jsc.sc().getCheckpointDir().get()


#: Lets Spark delete a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder; the shuffle files that led there go at once."""
    checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made under this setting


def tabled(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, for loops.

    A table has its true size; a checkpoint hands on the size that the planner
    guesses, which every join multiplies, so that its digits double each round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/skyquarry-{uuid.uuid4()}"
    with _tidy(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widened(df: DataFrame, order: str | None = None) -> DataFrame:
    """df over all cores where its files have fewer splits than there are cores; by ranges of ``order``, if given, so that rows stay in order."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:  # planned, not run
        return df
    return df.repartitionByRange(cores, order) if order else df.repartition(cores)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Texts:
    """Some texts as bytes: data, and offsets with one more entry than texts. Null counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def word_bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and its text's number."""
        data, off = self.data, self.offsets
        inside = ~IS_SEPARATOR[data]
        full = off[:-1] < off[1:]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = off[:-1][full]
        first[at] = inside[at]
        last = inside
        end = inside.copy()
        end[:-1] &= ~last[1:]
        at = off[1:][full] - 1
        end[at] = inside[at]
        starts, ends = np.flatnonzero(first), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(off, starts, side="right") - 1

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte span."""
        data = LOWER[self.data] if fold_case else self.data
        n = len(data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * powers(n + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def as_texts(column: pa.Array, chunk_bytes: int = 1 << 19) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts): slices of at most chunk_bytes, or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + chunk_bytes, side="right")) - 1)
        j = min(j, len(column))
        yield i, j, Texts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def grams(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive items of one owner, and the index of each one's first item."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(total[at]), at


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out
