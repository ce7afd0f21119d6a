"""A training corpus from raw documents: rules, classifier, near-duplicates, repeated passages, packing.

Each stage takes all that its predecessor kept and returns a DataFrame; all but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.llm import chaining, classifier, packing, quality_rules, setsketch
from skyquarry.llm.text import checkpoint_dir, checkpointed, fresh

#: Score below which the classifier rejects.
LEAST_SCORE = 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and the cutoffs certified on the labels of these documents keep.

    Null, empty and wordless texts fail the base rules and go; repeated rows are
    judged one by one; rows without doc_id count for no label; no rows give none.
    Texts are measured twice, for the cutoffs and for the decision: keeping the
    measures would mean to shuffle all texts by doc_id.
    """
    measured = checkpointed(quality_rules.features(docs))
    return quality_rules.keep(docs, quality_rules.calibrate(measured, _labels(spark, sf_dir)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what a classifier trained on the labels of these documents scores high enough.

    Null and empty texts get the bias's score; repeated rows are scored one by one;
    without labels every score is 0.5 and all rows stay; no rows give none.
    """
    return classifier.keep(docs, classifier.fit(docs, _labels(spark, sf_dir)), LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, similarity 0.8): that of the least doc_id.

    A row is known by doc_id and text, so a null doc_id is as good as any; rows that
    repeat both are one document.  Null, empty and wordless texts are like nothing
    and stay; extra columns are carried along; no rows give none.
    """
    found = setsketch.near_duplicates(docs, setsketch.Settings(words=5, percent=80))
    name, mark = fresh(docs, "kept", "mark")
    kept = found.where("representative").select(F.col("doc_id").alias(name), F.col("mark").alias(mark)).distinct()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)) & (text == F.col(mark)), "left_semi")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the repeats of passages that documents share; the first of each stays.

    Null, empty and short texts stay as they are; rows that repeat doc_id and text
    are one document; see chaining.cut_repeats.
    """
    return chaining.cut_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; null and empty texts are the closing id alone, repeated rows documents of their own."""
    return packing.pieces(packing.pack(docs, packing.vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", quality),
    ("near-duplicates", near_copies),
    ("repeated passages", passages),
    ("packing", sequences),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's documents are written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
