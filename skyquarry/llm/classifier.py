"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's features are its word n-grams: the words themselves (case folded) and
their forms (runs of lower-case, upper-case, digits; punctuation as it is), each
hashed into a fixed number of buckets.  A bucket's value is its share of the
text's n-grams, so a score is a sparse dot product whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquarry.llm.text import Texts, as_texts, grams, mix, widened

_FORM = np.arange(256, dtype=np.uint8)
_FORM[97:123] = 97
_FORM[128:] = 97
_FORM[65:91] = 65
_FORM[48:58] = 48


@dataclass(frozen=True)
class Settings:
    """max_labelled bounds the rows that training sees (those first by a hash of doc_id)."""

    bits: int = 18
    max_labelled: int = 8000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 0.01
    l1: float = 0.0005
    l2: float = 0.0005
    scale: float = 8.0


def ngrams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's number) of every n-gram, and the n-grams of each text."""
    starts, ends, owner = texts.word_bounds()
    words = texts.hash_spans(starts, ends, fold_case=True)
    form = _FORM[texts.data]
    fresh = np.ones(len(form), bool)
    fresh[1:] = form[1:] != form[:-1]
    fresh[starts] = True
    at = np.concatenate([[0], np.cumsum(fresh)])
    forms = Texts(form[fresh], np.array([0, int(at[-1])])).hash_spans(at[starts], at[ends])
    hashes, owners = [], []
    for kind, (own, sizes) in enumerate(((words, (1, 2)), (forms, (1, 2, 3)))):
        for k in sizes:
            h, first = grams(own, owner, k)
            hashes.append(mix(h + np.uint64(1 + 16 * kind + k)))
            owners.append(owner[first])
    owners = np.concatenate(owners)
    return np.concatenate(hashes), owners, np.bincount(owners, minlength=texts.n)


def _examples(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    for batch in batches:
        ids, labels = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
        for i, _, texts in as_texts(batch.column("text")):
            h, owner, total = ngrams(texts)
            key, count = np.unique((owner.astype(np.uint64) << np.uint64(s.bits)) | (h >> np.uint64(64 - s.bits)), return_counts=True)
            own = (key >> np.uint64(s.bits)).astype(np.int64)
            cut = np.searchsorted(own, np.arange(texts.n + 1))
            for j in range(texts.n):
                a, b = cut[j], cut[j + 1]
                yield ids[i + j], (key[a:b] & np.uint64((1 << s.bits) - 1)).astype(np.int64), count[a:b] * (s.scale / max(1, total[j])), labels[i + j]


def train(examples: Iterable[tuple[int, np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights, the bias last."""
    rows = sorted(examples, key=lambda x: (int(mix(np.array([x[0] or 0], np.int64).view(np.uint64))[0]), x[0] or 0))
    z = np.zeros((1 << s.bits) + 1)
    n = np.zeros_like(z)

    def weights(at):
        a = z[at]
        return np.where(np.abs(a) <= s.l1, 0.0, -(a - np.sign(a) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for _, at, x, label in rows:
            at, x = np.append(at, 1 << s.bits), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def score_texts(texts: Texts, w: np.ndarray, s: Settings) -> np.ndarray:
    h, owner, total = ngrams(texts)
    dot = np.bincount(owner, w[(h >> np.uint64(64 - s.bits)).astype(np.int64)], minlength=texts.n) * s.scale / np.maximum(total, 1)
    return 1 / (1 + np.exp(-np.clip(dot + float(w[-1]), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:  # noqa: B008
    """Weights from at most s.max_labelled labelled rows of which crc32(doc_id) mod 5 isn't 0.

    The rows are the first by a hash of doc_id, so the sample doesn't depend on
    order or partitions.  One task trains on it; its size is bounded by the
    parameter, and what reaches the driver is the weights alone.  Of several rows
    with one doc_id the least text counts, so that they can't add to the sample.
    Null or repeated labels: rows without doc_id or label don't count, of several labels
    for one document the largest does.  No labelled rows: all scores are 0.5.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.max_labelled)
    )
    sample = docs.select("doc_id", "text")
    chosen = sample.join(F.broadcast(usable), "doc_id")  # at most max_labelled rows of two numbers
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def learn(batches):
        yield pa.RecordBatch.from_arrays([pa.array([train(_examples(batches, s), s).tobytes()], pa.binary())], names=["w"])

    found = chosen.repartition(1).mapInArrow(learn, "w binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << s.bits) + 1, np.float32)


def score(docs: DataFrame, w: np.ndarray, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id and score of every row; null and empty texts get the bias's score. Weights are a megabyte, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def scored(batches):
        for batch in batches:
            out = [score_texts(t, shared.value, s) for _, _, t in as_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id bigint, score double")


def keep(docs: DataFrame, w: np.ndarray, threshold: float, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of docs, all columns, whose score is at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def kept(batches):
        for batch in batches:
            out = [score_texts(t, shared.value, s) for _, _, t in as_texts(batch.column(batch.schema.get_field_index("text")))]
            yield batch.filter(pa.array((np.concatenate(out) if out else np.zeros(0)) >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """A null doc_id belongs to no fold: it is not held out, and no label is its."""
    docs = widened(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
