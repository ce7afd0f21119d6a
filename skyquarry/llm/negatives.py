"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, so that all have the length of the longest; then a
larger inner product with an anchor (whose extra component is 0) is a smaller
distance, and the triangle inequality holds.  Each vector is stored under its
nearest pivot, sorted by its distance from it: the key.  A vector whose key lies in
[a, b] is no nearer to an anchor at distance d from the pivot than d - b or a - d,
so an anchor scans the key intervals around d, in expanding rounds, until that
bound for all that is unseen certifies what it has.

Scores are integers and compared as such; distances only say where to look, with a
margin for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquarry.engine.tables import kept

#: Rows (first by hash) that pivots are fitted on; every row is indexed.
SAMPLE = 4096
#: Key intervals a pivot has; the last is open.
CELLS = 24
#: Rows of a block, and anchors of a chunk, about.
BLOCK, CHUNK = 512, 128
#: Shares of the key intervals that may matter to a chunk, nearest first, that the rounds have seen.
SHARES = (0.125, 0.25, 0.5, 1.0)
#: Rounding of distances, as a share of the longest vector.
MARGIN = 1e-6
FAR = 1 << 62


@dataclass(frozen=True)
class Space:
    """dims, the longest vector's square, pivots with their extra component, width of a key interval."""

    dims: int
    square: int
    pivots: np.ndarray
    width: float = 1.0

    def distances(self, x: np.ndarray, extra: np.ndarray | float) -> np.ndarray:
        """Of rows with an extra component from the pivots."""
        own = (x.astype(np.float64) ** 2).sum(1) + np.square(extra)
        dot = x.astype(np.float64) @ self.pivots[:, :-1].T + np.outer(np.broadcast_to(extra, len(x)), self.pivots[:, -1])
        return np.sqrt(np.maximum(own[:, None] + (self.pivots**2).sum(1) - 2 * dot, 0))

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(float(self.square) - (x.astype(np.float64) ** 2).sum(1), 0))

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products; double arithmetic is exact below 2**53."""
        if self.square < 1 << 53:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of lists, filled up with zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    out = np.zeros((len(column), dims), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def fitted(rows: DataFrame, pivots: int | None = None) -> Space | None:
    """Pivots by a few rounds of k-means on a bounded sample; None for no rows."""
    whole = rows.agg(F.max(F.size("x")).alias("dims"), F.max(F.aggregate("x", F.lit(0).cast("bigint"), lambda a, b: a + b * b)).alias("square"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return None
    dims = max(whole["dims"], 1)
    some = rows.orderBy(F.xxhash64("x", "id"), "id").limit(SAMPLE).select("x").collect()  # at most SAMPLE rows
    x = np.array([[*r["x"], *[0] * (dims - len(r["x"]))] for r in some], np.int64)
    space = Space(dims, whole["square"], np.zeros((0, dims + 1)))
    points = np.unique(np.column_stack([x, space.extra(x)]), axis=0)
    k = pivots or min(256, max(4, round(math.sqrt(whole["n"]) / 16)))
    centres = points[np.unique(np.linspace(0, len(points) - 1, k).astype(int))]
    for _ in range(5):
        near = np.argmin(((points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T), axis=1)
        centres = np.array([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    space = Space(dims, whole["square"], centres)
    keys = space.distances(points[:, :-1], points[:, -1]).min(1)
    return Space(dims, whole["square"], centres, max(float(keys.max()) / (CELLS - 1), 1e-9))


def _keyed(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), space.dims)
            d = space.distances(x, space.extra(x))
            pivot = d.argmin(1)
            key = d[np.arange(len(x)), pivot]
            cell = np.minimum((key / space.width).astype(np.int64), CELLS - 1)
            yield pa.RecordBatch.from_pydict({"pivot": pivot.astype(np.int32), "cell": cell.astype(np.int32), "key": key, "id": b.column("id"), "label": b.column("label"), "anchor": b.column("anchor"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut into blocks of one key interval; within a block rows are sorted by id (nulls last), so a stable sort by score settles ties."""
    block, held = TaskContext.get().partitionId() << 32, []

    def cut(part: pa.Table, block: int) -> pa.RecordBatch:
        part = part.sort_by([("id", "ascending")])
        n = part.num_rows
        ids = part.column("id").combine_chunks()
        raw = lambda a: [np.ascontiguousarray(a, dtype=np.int64).tobytes()]
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int64()),
                "pivot": part.column("pivot").combine_chunks()[:1],
                "cell": part.column("cell").combine_chunks()[:1],
                "ids": raw(ids.fill_null(0)),
                "known": raw(ids.is_valid().to_numpy(zero_copy_only=False)),
                "labels": raw(part.column("label").to_numpy()),
                "anchors": raw(part.column("anchor").to_numpy()),
                "xs": [b"".join(part.column("x").to_pylist())],
                "n": pa.array([n], pa.int64()),
            }
        )

    def full(table: pa.Table, last: bool) -> Iterator[pa.Table]:
        at = np.stack([table.column(c).to_numpy() for c in ("pivot", "cell")])
        edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            open_end = not last and k == len(edges) - 2
            while j - i > BLOCK or (j > i and not open_end):
                yield table.slice(i, min(BLOCK, j - i))
                i += min(BLOCK, j - i)
            if open_end:
                held.append(table.slice(i, j - i))

    for b in batches:
        if b.num_rows:
            table = pa.concat_tables([*held, pa.Table.from_batches([b])])
            held.clear()
            for part in full(table, False):
                yield cut(part, block)
                block += 1
    if held:
        table = pa.concat_tables(held)
        held.clear()
        for part in full(table, True):
            yield cut(part, block)
            block += 1


_BLOCKS = "block bigint, pivot int, cell int, ids binary, known binary, labels binary, anchors binary, xs binary, n bigint"


def indexed(rows: DataFrame, space: Space) -> DataFrame:
    """The index of rows(id, label, x, anchor), a table of blocks.  Equal vectors may fill many blocks: id is the sort's last key."""
    keyed = rows.mapInArrow(_keyed(space), "pivot int, cell int, key double, id bigint, label bigint, anchor boolean, x binary")
    keyed = keyed.repartitionByRange("pivot", "cell", "key", "id").sortWithinPartitions("pivot", "cell", "key", "id")
    return kept(keyed.mapInArrow(_blocks, _BLOCKS))


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            at = np.flatnonzero(_ints(r["anchors"]))
            if len(at):
                xs = _ints(r["xs"]).reshape(r["n"], -1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": r["block"] * BLOCK + at,
                        "anchor_id": _ints(r["ids"])[at],
                        "label": _ints(r["labels"])[at],
                        "x": pa.array([xs[i].tobytes() for i in at], pa.binary()),
                        "pivot": np.full(len(at), r["pivot"], np.int32),
                    }
                )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            m = r["members"]
            raw = lambda name: np.array([v[name] for v in m], np.int64).tobytes()
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([r["chunk"]], pa.int64()), "rows": [raw("anchor")], "own": [raw("label")], "qs": [b"".join(v["x"] for v in m)], "los": [raw("lo")], "his": [raw("hi")]}
            )


def _chunks(anchors: DataFrame) -> DataFrame:
    """Anchors(chunk, anchor, label, x, lo, hi) by chunk, as arrays: a table."""
    members = anchors.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "label", "x", "lo", "hi")).alias("members"))  # some CHUNK of them
    return kept(members.mapInArrow(_packed, "chunk bigint, rows binary, own binary, qs binary, los binary, his binary"))


class Reach:
    """What a chunk's anchors may have to look at: key intervals, in the order of the bound on how near their vectors can be."""

    def __init__(self, space: Space, cells: np.ndarray, r: dict):
        self.rows = _ints(r["rows"])
        m = len(self.rows)
        q = _ints(r["qs"]).reshape(m, space.dims)
        self.q, self.lo, self.hi = q, _ints(r["los"]).reshape(m, -1), _ints(r["his"]).reshape(m, -1)
        self.limit = (q.astype(np.float64) ** 2).sum(1) + float(space.square)  # distance**2 = limit - 2 * score
        margin = MARGIN * math.sqrt(max(space.square, 1))
        d = space.distances(q, 0.0)[:, cells[:, 0]]
        low, high = cells[:, 1] * space.width, np.where(cells[:, 1] == CELLS - 1, np.inf, (cells[:, 1] + 1) * space.width)
        least, most = np.maximum(np.maximum(d - high, low - d), 0) - margin, d + high + margin
        asked = self.lo <= self.hi
        best = np.where(asked, self.hi, -FAR).max(1).astype(np.float64)
        worst = np.where(asked, self.lo, FAR).min(1).astype(np.float64)
        near, far = (np.sqrt(np.maximum(self.limit - 2 * s, 0)) for s in (best, worst))
        wanted = asked.any(1)[:, None] & (most >= near[:, None]) & (least <= far[:, None] + margin)
        self.bound = np.where(wanted, least, np.inf).min(0)

    def radius(self, share: float) -> float:
        """Up to where the bound has been seen once this share of the intervals has."""
        known = np.sort(self.bound[np.isfinite(self.bound)])
        return float(known[min(len(known), max(1, math.ceil(share * len(known)))) - 1]) if len(known) else math.inf

    def unseen(self, share: float) -> np.ndarray:
        """A score that nothing unseen exceeds, by anchor."""
        if share >= 1 or not math.isfinite(r := self.radius(share)):
            return np.full(len(self.rows), -FAR, np.float64)
        return (self.limit - max(r, 0) ** 2) / 2 + 1e-9 * self.limit + 1


def _wants(space: Space, cells: np.ndarray, before: float, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                reach = Reach(space, cells, r)
                seen = reach.radius(before) if before else -math.inf
                at = np.flatnonzero((reach.bound > seen) & (reach.bound <= reach.radius(share)) & np.isfinite(reach.bound))
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(at), r["chunk"], np.int64), "pivot": cells[at, 0].astype(np.int32), "cell": cells[at, 1].astype(np.int32)})

    return run


def _uncertain(space: Space, cells: np.ndarray, share: float):
    """(chunk, anchor, slot, lo, unseen) of what is asked: a slot that has its number of scores above ``unseen``, or whose lo is above it, is certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                reach = Reach(space, cells, r)
                i, slot = np.nonzero((reach.lo <= reach.hi) & (reach.lo <= reach.unseen(share)[:, None]))
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(i), r["chunk"], np.int64), "anchor": reach.rows[i], "slot": slot.astype(np.int32), "unseen": reach.unseen(share)[i]})

    return run


def _scored(space: Space, k: int, same: bool):
    """The first k rows of a block for each slot of a chunk's anchors; what falls behind k others that this task has seen is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                rows, own, los, his = (_ints(r[n]) for n in ("rows", "own", "los", "his"))
                q, x, labels = _ints(r["qs"]).reshape(len(rows), -1), _ints(r["xs"]).reshape(r["n"], -1), _ints(r["labels"])
                score, at = space.exact(q, x), r["block"] * BLOCK + np.arange(r["n"])
                open_ = (own[:, None] == labels) == same
                open_ &= rows[:, None] != at
                order = np.argsort(-score, axis=1, kind="stable")
                score, open_ = np.take_along_axis(score, order, 1), np.take_along_axis(open_, order, 1)
                slots = len(los) // len(rows)
                los, his = los.reshape(-1, slots), his.reshape(-1, slots)
                bar = bars.setdefault(r["chunk"], np.full((len(rows), slots), -FAR, np.int64))
                for s in range(slots):
                    fits = open_ & (score >= los[:, s, None]) & (score <= his[:, s, None]) & (score >= bar[:, s, None])
                    rank = np.cumsum(fits, axis=1)
                    i, j = np.nonzero(fits & (rank <= k))
                    if not len(i):
                        continue
                    full = fits & (rank == k)
                    bar[:, s] = np.maximum(bar[:, s], np.where(full.any(1), np.where(full, score, -FAR).max(1), -FAR))
                    put = order[i, j]
                    ids = pa.array(_ints(r["ids"])[put], mask=_ints(r["known"])[put] == 0)
                    yield pa.RecordBatch.from_pydict({"anchor": rows[i], "slot": np.full(len(i), s, np.int32), "score": score[i, j], "id": ids, "row": at[put]})

    return run


@contextmanager
def _few_rows_a_batch(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """Arrow batches of rows that hold a block and a chunk each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_FOUND = "anchor bigint, slot int, score bigint, id bigint, row bigint"


def searched(blocks: DataFrame, chunks: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id, row, rank): for each slot of each anchor the first k rows of the same (or another) label whose score is in [lo, hi].

    Each round looks at the next key intervals of the chunks that still have an
    uncertain slot, and no block twice.  Chunks and blocks meet by joins on the key
    interval and on block and chunk, so none is broadcast unless Spark finds it small.
    """
    cells = np.array([(r["pivot"], r["cell"]) for r in blocks.select("pivot", "cell").distinct().collect()], np.int64).reshape(-1, 2)  # at most pivots x CELLS
    where = blocks.select("block", "pivot", "cell")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    top, now, before = None, chunks, 0.0
    for share in SHARES:
        wants = now.select("chunk", "rows", "qs", "los", "his").mapInArrow(_wants(space, cells, before, share), "chunk bigint, pivot int, cell int")
        pairs = wants.join(where, ["pivot", "cell"]).select("chunk", "block")
        met = pairs.join(blocks.drop("pivot", "cell", "anchors"), "block").join(now, "chunk")
        with _few_rows_a_batch(blocks.sparkSession):
            found = met.mapInArrow(_scored(space, k, same), _FOUND)
            found = found if top is None else found.unionByName(top.drop("rank"))
            top = kept(found.withColumn("rank", rank).where(F.col("rank") <= k), replaces=top)
        if share == SHARES[-1]:
            return top
        uncertain = now.select("chunk", "rows", "qs", "los", "his").mapInArrow(_uncertain(space, cells, share), "chunk bigint, anchor bigint, slot int, unseen double")
        last = top.where(F.col("rank") == k).select("anchor", "slot", "score")
        uncertain = uncertain.join(last, ["anchor", "slot"], "left").where("score is null or score <= unseen").select("chunk").distinct()
        now = kept(now.join(uncertain, "chunk", "left_semi"), replaces=None if now is chunks else now)
        if now.isEmpty():
            return top
        before = share
    return top


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(id, label, x list of bigint).

    A score is the inner product with the anchor; higher ones come first, then
    smaller ids, null ids last.  An anchor's positives are its first ``positives``
    other rows of its label; each one's negatives are the first ``negatives`` rows of
    other labels with low % to high % of its score.

    Rows with a null label, x or component take no part.  Shorter lists are filled up
    with zeros.  Rows that repeat an id or a vector are rows of their own; an anchor
    is not its own positive, a copy of it may be.  Inner products that don't fit a
    long are an arithmetic error.  Other columns are not looked at; no rows give none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("x").cast("array<bigint>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    space = fitted(rows)
    if space is None:
        return spark.createDataFrame([], schema)
    blocks = indexed(rows, space)
    anchors = kept(blocks.mapInArrow(_anchors, "anchor bigint, anchor_id bigint, label bigint, x binary, pivot int"))
    dealt = anchors.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))  # one row a pivot
    chunked = anchors.join(dealt, "pivot").withColumn("chunk", F.col("pivot").cast("bigint") * F.lit(1 << 32) + F.pmod(F.xxhash64("anchor"), "parts")).drop("parts")
    whole = _chunks(chunked.withColumns({"lo": F.array(F.lit(-FAR)), "hi": F.array(F.lit(FAR))}))
    own = searched(blocks, whole, space, positives, same=True)
    part = lambda percent, more: f"score div 100 * {percent} + (score % 100 * {percent} + {more}) div 100"  # noqa: E731  no overflow
    band = {"lo": (part(low, 99), 1), "hi": (part(high, 0), 0)}  # no band: from 1 to 0
    of_rank = lambda i, of, none: F.coalesce(F.max(F.when(F.col("rank") == i, F.expr(of))), F.lit(none).cast("bigint"))
    bands = own.where("score >= 0").groupBy("anchor").agg(*(F.array(*(of_rank(i + 1, of, none) for i in range(positives))).alias(n) for n, (of, none) in band.items()))
    other = searched(blocks, _chunks(chunked.join(bands, "anchor")), space, negatives, same=False)
    firsts = own.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = other.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).drop("row").join(firsts, ["anchor", "slot"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def quantised(vectors: DataFrame) -> DataFrame:
    """id, label, x of vectors(vec_id, embedding, label) as the registered query takes them; nulls and components that aren't finite leave a row out."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 256)).alias("x"))


def query(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")), F.col("id") % 50 == 0)


ORACLE = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.rid AS ar, a.vec_id AS anchor_id, b.rid AS br, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.k ORDER BY n.score DESC, n.vec_id, n.br) AS rank
      FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
WHERE rank <= 3
"""
