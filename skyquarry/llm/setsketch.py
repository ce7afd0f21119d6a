"""Near-duplicates by SetSketch registers.

A document's word shingles form a set.  Register i holds the exponentially spaced,
truncated minimum of an exponential variate over the set's members: the registers
of a union are the larger of both, and two sets agree in a register with about
their Jaccard similarity.  Bands of registers propose candidates; documents that
candidates connect form clusters.  Within a cluster, the likelihood of a pair's
register comparisons (with both sizes known) estimates its similarity; what comes
near the threshold is confirmed on the full sets.  Pairs are tried if they share a
band, in clusters of any size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.llm.graph import components_of_buckets, connected_components, spread_join
from skyquarry.llm.text import Texts, as_texts, checkpointed, grams, mix, widened


@dataclass(frozen=True)
class Settings:
    """A pair is linked if 100 * intersection >= percent * union of its shingle sets."""

    words: int = 5
    percent: int = 80
    registers: int = 100
    miss: float = 1e-5
    base: float = 1.001
    rate: float = 20.0
    #: Shingles, and pairs with a common band, of the clusters that one task resolves in memory; larger ones go through rounds of joins.
    most: int = 1 << 24
    most_pairs: int = 1 << 28

    def rows(self) -> int:
        """Registers a band: as many as keep the chance of missing a pair at the threshold below ``miss``."""
        fits = [r for r in range(1, 9) if (1 - (self.percent / 100) ** r) ** (self.registers // r) <= self.miss]
        return max(fits, default=1)

    def margin(self) -> float:
        """Pairs of which the registers say less are not confirmed: five standard errors below the threshold."""
        return self.percent / 100 - 5 * math.sqrt(0.25 / self.registers)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def shingle_sets(texts: Texts, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words than a shingle, the whole sequence is one."""
    starts, ends, owner = texts.word_bounds()
    h = texts.hash_spans(starts, ends, fold_case=True)
    g, first = grams(h, owner, words)
    own = owner[first]
    cut, total = np.searchsorted(own, np.arange(texts.n + 1)), np.searchsorted(owner, np.arange(texts.n + 1))
    out = []
    for i in range(texts.n):
        part = g[cut[i] : cut[i + 1]]
        n = total[i + 1] - total[i]
        if not len(part) and n:
            part = mix(grams(h[total[i] : total[i + 1]], np.zeros(n, np.int64), int(n))[0] + np.uint64(n))
        out.append(np.unique(part))
    return out


def registers(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """One row of registers for each nonempty set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(x) for x in sets[:-1])])
    factor, shift = _seeds(s.registers)
    least = np.empty((len(sets), s.registers), np.uint64)
    for i in range(s.registers):
        least[:, i] = np.minimum.reduceat(flat * factor[i] + shift[i], at)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / s.rate
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(s.base)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray, s: Settings) -> np.ndarray:
    """The hashes of each row's bands; the band's number is part of its hash."""
    rows, count = s.rows(), s.registers // s.rows()
    h = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(regs), count)).copy()
    for r in range(rows):
        h = mix(h + regs[:, r : rows * count : rows].astype(np.uint64))
    return h


def estimate(more: np.ndarray, less: np.ndarray, n: int | np.ndarray, sizes: np.ndarray, s: Settings) -> np.ndarray:
    """Maximum-likelihood similarity of sets of n members to others, from how many registers are larger and smaller."""
    u = (n / (n + sizes))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (s.base - 1) / s.base) / math.log(s.base)
    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    like = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny)
    like += (s.registers - more - less)[:, None] * np.log(np.maximum(1 - up - down, tiny))
    best = like.argmax(axis=1)
    return grid[np.arange(len(best)), best]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large or not small:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (small + large - common)


def resolve(nodes: list[int], sets: list[np.ndarray], s: Settings) -> list[int]:
    """The least node of each one's component, by links on the full sets of pairs that share a band."""
    regs = registers(sets, s)
    bands = band_keys(regs, s)
    sizes = np.array([len(x) for x in sets])
    component = np.arange(len(sets))
    least = s.margin()

    def near(i: int, others: np.ndarray) -> np.ndarray:
        parts = []
        for k in range(0, len(others), 4096):
            x = regs[others[k : k + 4096]]
            parts.append(estimate((x < regs[i]).sum(1), (x > regs[i]).sum(1), int(sizes[i]), sizes[others[k : k + 4096]], s))
        guess = np.concatenate(parts)
        order = np.argsort(-guess, kind="stable")
        return others[order[guess[order] >= least]]

    for c in range(bands.shape[1]):
        order = np.argsort(bands[:, c], kind="stable")
        edge = np.flatnonzero(np.append(True, bands[order[1:], c] != bands[order[:-1], c]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            group = order[a:b]
            if b - a == 1 or (component[group] == component[group[0]]).all():
                continue
            for k in range(1, b - a):
                i = int(group[k])
                others = group[:k][component[group[:k]] != component[i]]
                if c and len(others):  # pairs of an earlier band have been tried
                    others = others[~(bands[others, :c] == bands[i, :c]).any(axis=1)]
                if not len(others):
                    continue
                _, first = np.unique(component[others], return_index=True)  # one of each component, then the rest
                rest = np.ones(len(others), bool)
                rest[first] = False
                for part in (others[first], others[rest]):
                    for j in near(i, part) if len(part) else ():
                        if component[j] != component[i] and linked(sets[i], sets[int(j)], s.percent):
                            component[component == component[j]] = component[i]
    names = np.array(nodes, np.int64)
    smallest = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(smallest, component, names)
    return smallest[component].tolist()


def _sketched(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for _, _, texts in as_texts(batch.column("text"), 1 << 19):
                sets = shingle_sets(texts, s.words)
                full = [x for x in sets if len(x)]
                if full:
                    h = band_keys(registers(full, s), s).view(np.int64).tolist()
                k = 0
                for x in sets:
                    sizes.append(len(x))
                    keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    bands.append(h[k] if len(x) else [])
                    k += bool(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n_shingles", "set_key", "bands"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id bigint, mark bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _in_memory(members: DataFrame, s: Settings) -> DataFrame:
    """members(cluster, node, text) to (node, label). One cluster is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(resolve(nodes, sets, s), pa.int64())], names=["node", "label"])

        for batch in batches:
            clusters, ids = batch.column("cluster").to_pylist(), batch.column("node").to_pylist()
            for i, j, texts in as_texts(batch.column("text")):
                for k, x in zip(range(i, j), shingle_sets(texts, s.words), strict=True):
                    if clusters[k] != now:
                        if nodes:
                            yield emit()
                        now, nodes, sets = clusters[k], [], []
                    nodes.append(ids[k])
                    sets.append(x)
        if nodes:
            yield emit()

    return members.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(run, "node bigint, label bigint")


def _registered(texts: DataFrame, s: Settings) -> DataFrame:
    """node, n (members of its set) and registers of texts(node, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, _, t in as_texts(batch.column("text"), 1 << 19) for x in shingle_sets(t, s.words)]
            if sets:
                regs = [x.tobytes() for x in registers(sets, s)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array(regs, pa.binary())], names=["node", "n", "regs"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, n bigint, regs binary")


def _sides(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """pairs(a, b) with both nodes' columns; a node in many pairs is no task of its own."""
    for side, other in (("a", "b"), ("b", "a")):
        own = facts.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        pairs = spread_join(pairs, own, [side], [other])
    return pairs


def _verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose registers come near the threshold and whose full sets are linked."""

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.int32) for c in ("regs_a", "regs_b"))
                n, m = (batch.column(c).to_numpy(False) for c in ("n_a", "n_b"))
                guess = estimate((y < x).sum(1), (y > x).sum(1), n, m, s)
                yield batch.select(["a", "b"]).filter(pa.array(guess >= s.margin()))

    def sure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                left, right = ([x for _, _, t in as_texts(batch.column(c)) for x in shingle_sets(t, s.words)] for c in ("text_a", "text_b"))
                yield batch.select(["a", "b"]).filter(pa.array([linked(x, y, s.percent) for x, y in zip(left, right, strict=True)], pa.bool_()))

    near = checkpointed(_sides(pairs, sketches, "n", "regs").select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(likely, "a bigint, b bigint"))
    return _sides(near, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(sure, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, mark (a hash of the text), n_shingles, component_id and representative of every row of docs.

    component_id is the least doc_id that links reach.  Documents with equal sets
    are one node from the start, so copies are never paired; buckets link to one
    member, so nothing is quadratic in a bucket's size before clusters are known.
    Within a cluster, pairs that share a band are tried: those whose registers say
    that they come near the threshold are confirmed on the full sets.  One task
    resolves clusters up to s.most shingles and s.most_pairs such pairs; larger ones
    go through rounds of joins that try the same pairs.  A pair at the threshold
    shares no band with probability s.miss at most, and its registers mislead (by
    five standard errors) in fewer than 1e-6 of all cases.

    representative: true for one document of each component, that of the least
    doc_id (of equal ones the least mark).  Rows that repeat both are one document.

    Null, empty and wordless texts: an empty set, linked with nothing, component_id
    is their own doc_id, each its own representative.  Repeated rows are equal sets.
    Null doc_id: never the least; component_id is null if all of a component are
    null.  Other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketched = checkpointed(_sketched(own, s))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("one")
    nodes = sketched.where("set_key is not null").groupBy("set_key")
    nodes = nodes.agg(one, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", "one", "n", "bands"))  # numbers are fixed by the checkpoint
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("centre < last")
    members = checkpointed(members.join(buckets.select("bucket", "centre", "size"), "bucket"))
    clusters = connected_components(members.where("centre <> node").select("node", "centre").distinct(), "node", "centre")
    clusters = checkpointed(clusters.withColumnRenamed("component", "cluster"))
    needed = clusters.join(nodes.select("node", "one", "n"), "node")
    size = needed.groupBy("cluster").agg(F.sum("n").alias("shingles"))
    pairs = members.where("centre = node").select("node", F.expr("size * (size - 1) div 2").alias("pairs")).join(clusters, "node").groupBy("cluster").agg(F.sum("pairs").alias("pairs"))
    large = checkpointed(size.join(pairs, "cluster").where((F.col("shingles") > s.most) | (F.col("pairs") > s.most_pairs)).select("cluster", F.lit(True).alias("large")))
    none = large.isEmpty()
    needed = needed.withColumn("large", F.lit(False)) if none else needed.join(large, "cluster", "left")
    needed = needed.select("node", "cluster", F.coalesce("large", F.lit(False)).alias("large"), F.col("one.doc_id").alias("id"), F.col("one.mark").alias("mark"))
    marked = own.select("doc_id", F.xxhash64("text").alias("own_mark"), "text")
    texts = needed.join(marked, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("own_mark"))).select("node", "cluster", "large", "text")
    if none:
        labels = _in_memory(_single(texts), s)
    else:
        texts = checkpointed(_single(texts))
        labels = _in_memory(texts.where("not large"), s)
        far = texts.where("large").select("node", "text")
        sketches = checkpointed(_registered(far, s))
        inside = members.select("bucket", "node").join(far.select("node"), "node", "left_semi")
        labels = labels.union(components_of_buckets(inside, lambda p: _verified(p, far, sketches, s)))
    named = nodes.select("node", "set_key", "one").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = checkpointed(named)
    least = named.groupBy("label").agg(F.min("one").alias("best"))
    named = named.join(least, "label").select("set_key", "best")
    out = spread_join(sketched.drop("bands"), named, ["set_key"], ["doc_id", "mark"], "left")
    alone = F.col("set_key").isNull()
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    return out.select("doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), (alone | first).alias("representative"))


def _single(texts: DataFrame) -> DataFrame:
    """One row a node: of repeated rows one is enough."""
    return texts.groupBy("node", "cluster", "large").agg(F.first("text").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = widened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = near_duplicates(docs, Settings(words=3, percent=85)).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach) AS component_id, d.doc_id = min(reach) AS kept
FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
