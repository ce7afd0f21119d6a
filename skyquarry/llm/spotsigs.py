"""SpotSigs document fingerprints.

A signature is an anchor with the chain of the next content words after it.
Anchors are common words: those of a fixed list for four languages, words of one or
two characters (particles, in most languages), and marks that stand alone.  So that
lists and tables have signatures too, the start of a text, of a line and of what
follows a word with a mark at its end counts as an anchor.  Content words are all
others.  A text's signatures form a set; its fingerprint is the set's size and all
its hashes, so it is exact and equal texts have equal ones.

Similar documents are searched for by set length: sets of Jaccard similarity t have
lengths within a factor t, so they lie in one of two neighbouring length partitions;
there they must share one of their rarest signatures.  What shares one is compared
by Jaccard similarity, given up as soon as the lengths or the part not yet seen rule
it out.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyquarry.llm.graph import components_of_buckets, spread_join
from skyquarry.llm.text import IS_SEPARATOR, Texts, as_texts, checkpointed, mix

#: The anchors, common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that for it was on with as by at from this be are an or not have "
    "le la les de des du un une et en que qui dans pour sur est au par il elle ne pas ce plus "
    "der die das und den von zu mit ist im dem nicht ein eine als auch es auf für sich des "
    "el los las y se con no su al lo como más pero sus o"
).split()
CHAIN = 2


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    return Texts(np.frombuffer(b"".join(raw), np.uint8), off).hash_spans(off[:-1], off[1:])


_IS_PUNCTUATION = np.zeros(256, bool)
_IS_PUNCTUATION[list(string.punctuation.encode())] = True
_ANCHORS = np.sort(_hashes(sorted(set(ANCHORS))))
_MAYBE = np.zeros(65536, bool)
_MAYBE[(_ANCHORS & np.uint64(65535)).astype(np.int64)] = True


def _is_anchor(h: np.ndarray) -> np.ndarray:
    out = _MAYBE[(h & np.uint64(65535)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = np.isin(h[at], _ANCHORS)
    return out


def signature_sets(texts: Texts) -> list[np.ndarray]:
    """Sorted distinct 32-bit signature hashes of each text; a text with a word has one at least."""
    starts, ends, owner = texts.word_bounds()
    n = len(starts)
    if not n:
        return [np.zeros(0, np.uint32)] * texts.n
    data = texts.data
    letter = ~_IS_PUNCTUATION[data]
    letter[IS_SEPARATOR[data]] = False
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(letter, at, -1))[ends - 1]
    first = np.minimum.accumulate(np.where(letter, at, len(data))[::-1])[::-1][starts]
    bare = last >= starts  # words that are more than marks
    h = texts.hash_spans(np.where(bare, first, starts), np.where(bare, last + 1, ends), fold_case=True)
    points = np.cumsum(np.append(0, (data & 0xC0) != 0x80))
    size = points[np.where(bare, last + 1, ends)] - points[np.where(bare, first, starts)]
    common = ~bare | (size <= 2) | _is_anchor(h)
    lines = np.cumsum(np.append(0, data == 10))
    begins = np.append(True, (owner[1:] != owner[:-1]) | (lines[starts[1:]] > lines[ends[:-1]]) | (last[:-1] + 1 < ends[:-1]))
    content = np.flatnonzero(~common)
    sig, own = [], []
    for anchors, mark in ((np.flatnonzero(common), h), (np.flatnonzero(begins & ~common), None)):
        # after a common word: the next content words; at a beginning: those from here on
        follow = np.searchsorted(content, anchors, side="right" if mark is not None else "left")
        value = mark[anchors] if mark is not None else np.ones(len(anchors), np.uint64)
        for i in range(CHAIN):
            k = np.minimum(follow + i, max(len(content) - 1, 0))
            fits = (follow + i < len(content)) & (owner[content[k]] == owner[anchors]) if len(content) else np.zeros(len(anchors), bool)
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(fits, h[content[k]] if len(content) else np.uint64(0), np.uint64(0)))
        sig.append(value)
        own.append(owner[anchors])
    sig, own = np.concatenate(sig), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    sig, own = sig[order], own[order]
    cut = np.searchsorted(own, np.arange(texts.n + 1))
    short = (sig >> np.uint64(32)).astype(np.uint32)
    return [np.unique(short[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fingerprint(signatures: np.ndarray) -> str:
    return f"{len(signatures):x}:{signatures.astype('>u4').tobytes().hex()}"


def parse(text: str) -> tuple[int, np.ndarray]:
    size, _, digits = text.partition(":")
    return int(size, 16), np.frombuffer(bytes.fromhex(digits), ">u4").astype(np.uint32)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 0 where it is below ``least``; two empty sets are alike.

    Pruned: sets whose sizes alone keep it below are not compared, and blocks of
    signatures are compared only as long as what is left can still reach it.
    """
    (n, x), (m, y) = a, b
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    if n > m:
        (n, x), (m, y) = (m, y), (n, x)
    need, have = math.ceil(least * (n + m) / (1 + least) - 1e-9), 0
    step = n if not least else 256
    for i in range(0, n, step):
        if have + n - i < need:
            return 0.0
        part = x[i : i + step]
        at = np.searchsorted(y, part)
        have += int(np.count_nonzero(y[np.minimum(at, m - 1)] == part))
    found = have / (n + m - have)
    return found if found >= least else 0.0


def length_partition(n: Column, least: float) -> Column:
    """Lengths within a factor ``least`` of each other lie in one partition or in neighbouring ones."""
    return F.floor(F.log(n) / F.lit(math.log(1 / least)) + F.lit(1e-9)).cast("int")


def similar_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_signatures, class_id and n_links of every row of docs.

    class_id is the least doc_id that pairs with a likeness of ``least`` or more
    reach; n_links the number of other documents with an equal set (copies, which
    are one node here and never paired).  Sets are cut into length partitions; each
    is looked up in its own and the next one by its rarest signatures: two sets
    with Jaccard similarity t share one of the first n - ceil(t n) + 1 in any common
    order, and the order by frequency keeps common ones out.  Documents that share
    such a signature are a bucket, compared as graph.components_of_buckets does it.

    Null, empty and wordless texts have no signatures, are like nothing and a class
    of their own.  Repeated rows are copies.  Null doc_id: never the least; class_id
    is null if all of a class are null.  Other columns are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, _, t in as_texts(batch.column("text")) for x in signature_sets(t)]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([x.astype("<u4").tobytes() for x in sets], pa.binary())],
                names=["doc_id", "n_signatures", "set_key", "signatures"],
            )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = checkpointed(own.mapInArrow(run, "doc_id bigint, n_signatures bigint, set_key binary, signatures binary"))
    nodes = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("signatures").alias("signatures"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("n", F.expr("length(signatures) div 4")))

    def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [np.frombuffer(x, np.uint32) for x in batch.column("signatures").to_pylist()]
                sizes = np.array([len(x) for x in sets])
                flat = np.concatenate(sets).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(False), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(flat)], names=["node", "n", "signature"])

    postings = nodes.select("node", "signatures").mapInArrow(exploded, "node bigint, n bigint, signature bigint")
    often = postings.groupBy("signature").agg(F.count(F.lit(1)).alias("often")).where("often > 1")  # what one set has links nothing
    ranked = spread_join(postings, often, ["signature"], ["node"])
    order = Window.partitionBy("node").orderBy("often", "signature")
    # a set's signatures in no other set come first in its order: they take places of the prefix
    ranked = ranked.withColumn("rank", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node")))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    part = length_partition(F.col("n"), least)
    buckets = prefix.select("node", F.explode(F.array(part, part + 1)).alias("part"), "signature")
    members = buckets.select(F.xxhash64("part", "signature").alias("bucket"), "node").distinct()
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = checkpointed(spread_join(members, size, ["bucket"], ["node"]))

    def alike(pairs: DataFrame) -> DataFrame:
        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = ([np.frombuffer(v, np.uint32) for v in batch.column(c).to_pylist()] for c in ("signatures_a", "signatures_b"))
                good = [likeness((len(u), u), (len(v), v), least) > 0 for u, v in zip(x, y, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        for side, other in (("a", "b"), ("b", "a")):
            facts = nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("signatures").alias(f"signatures_{side}"))
            pairs = spread_join(pairs, facts, [side], [other])
        pairs = pairs.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)
        return pairs.select("a", "b", "signatures_a", "signatures_b").mapInArrow(compare, "a bigint, b bigint")

    labels = components_of_buckets(members, alike)
    named = nodes.select("node", "set_key", "least", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = checkpointed(named)
    best = named.groupBy("label").agg(F.min("least").alias("class_id"))
    named = named.join(best, "label").select("set_key", "class_id", "copies")
    out = spread_join(rows.drop("signatures"), named, ["set_key"], ["doc_id"], "left")
    return out.select("doc_id", "n_signatures", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_links"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; null, empty and wordless texts have the empty fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(x) for _, _, t in as_texts(batch.column("text")) for x in signature_sets(t)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def followed(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (bucket, guest, key, doc_id, text), sorted so that each text's successor in descending doc_id comes next.

    Buckets are ranges of doc_id, one a partition.  A bucket's last document is
    followed by a copy (guest) of the next bucket's first one, the last bucket's by
    a copy of the very first.  Only quantiles and each bucket's first id reach the
    driver: as many as there are partitions.  Ties are ordered by text; null ids
    come last.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    bounds = np.unique(np.array(own.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], float)).astype(np.int64)

    @F.pandas_udf("bigint")
    def bucket_of(key: pd.Series) -> pd.Series:  # a binary search; built-ins would scan all bounds for each row
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(np.int64), side="right"))

    placed = own.withColumn("bucket", bucket_of("key"))
    first = {r["bucket"]: r["key"] for r in placed.groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    filled = sorted(first)
    heads = np.array(sorted(first.values()), np.int64)
    before = {first[b]: filled[i - 1] for i, b in enumerate(filled)}  # the bucket that wants it as a guest
    targets = np.array([before[k] for k in heads.tolist()], np.int64)

    @F.pandas_udf("bigint")
    def guest_in(key: pd.Series) -> pd.Series:
        x = key.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(heads, x), max(len(heads) - 1, 0))
        return pd.Series(np.where(heads[at] == x, targets[at], -1) if len(heads) else np.full(len(x), -1))

    placed = placed.withColumn("wanted", guest_in("key"))
    at = lambda b, g: F.struct(F.col(b).alias("bucket"), F.lit(g).alias("guest"))
    places = F.when(F.col("wanted") >= 0, F.array(at("bucket", 0), at("wanted", 1))).otherwise(F.array(at("bucket", 0)))
    rows = placed.select("doc_id", "key", "text", F.explode(places).alias("place")).select("place.bucket", "place.guest", "key", "doc_id", "text")
    return rows.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.desc("key"), "text")


SCHEMA = "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every row's fingerprint, its edited text and that one's fingerprint, and its likeness to that and to its successor.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many of the next document's text (or all of it) in descending doc_id; the last
    document is followed by the first, a single one by itself.  Null text: empty.
    Repeated rows follow each other.
    """

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text) with the successor of the last one at the end."""
        texts = [t for _, t in rows]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
        sets = [x for _, _, t in as_texts(pa.array(texts + edited, pa.large_string())) for x in signature_sets(t)]
        marks = [(len(x), x) for x in sets]
        own, made, n = marks[: len(texts)], marks[len(texts) :], len(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array([fingerprint(x) for x in sets[:n]], pa.string()),
                pa.array([fingerprint(x) for x in sets[len(texts) :]], pa.string()),
                pa.array([likeness(own[i], made[i]) for i in range(n)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in range(n)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, size, closed = None, [], 0, True
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id")]
            texts = batch.column("text")
            for k, (b, guest, doc_id) in enumerate(zip(*columns, strict=True)):
                if b != bucket:
                    bucket, waiting, size, closed = b, [], 0, False
                if closed:
                    continue
                text = texts[k].as_py() or ""
                waiting.append((doc_id, text))
                size += len(text)
                if guest:
                    closed = True
                    if len(waiting) > 1:
                        yield settle(waiting)
                    waiting = []
                elif size > 1 << 20 and len(waiting) > 1:
                    yield settle(waiting)
                    waiting, size = waiting[-1:], len(text)

    return followed(docs, parts).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = compare_with_next(docs)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def similar(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
