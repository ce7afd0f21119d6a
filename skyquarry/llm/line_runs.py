"""Line dedup: lines that many documents hold are dropped from all of them.  DataFrame and SQL functions only.

What is known of lines is kept as in a log-structured store: sorted runs of
(line hash, number of documents) in levels.  A batch of documents is counted,
merge-anti-joined with the runs (lines that are known to be common aren't counted
again), and added as a run of its own.  A level that is full is compacted into one
run of the next.  Runs are tables bucketed and sorted by hash, so neither
anti-joins nor compactions shuffle them again.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.engine.tables import fresh_path, kept, removed, tidy

#: What is stripped from a line's ends.
WHITE = " \t\n\x0b\x0c\r"
#: Runs of a level, when they are compacted into one of the next.
FANOUT = 2
#: Batches that the registered query makes of a table's files.
BATCHES = 4
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def keys_of(lines: Column) -> Column:
    """Lines without white space at their ends, A-Z lower-cased.  Lines of ASCII alone take the faster function."""
    lowered = lambda s: F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.transform(lines, lambda s: F.btrim(s, F.lit(WHITE))), lowered)


def hashed(c: str) -> list[Column]:
    """128 bits, in two columns."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(7), c).alias("h2")]


class Runs:
    """Levelled sorted runs of (h1, h2, docs); a hash's documents are the sum over all runs.

    Runs lie in the shared folder and are tables of the session's catalog while they
    live.  The number of buckets is that of shuffle partitions, so a batch's counts
    leave their aggregation already dealt as the runs are.
    """

    def __init__(self, spark: SparkSession, least_docs: int, least_chars: int = 1, fanout: int = FANOUT):
        self.spark, self.least_docs, self.least_chars, self.fanout = spark, least_docs, least_chars, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, counts: DataFrame) -> str:
        name, path = f"skyquarry_run_{uuid.uuid4().hex}", fresh_path(self.spark)
        with tidy(self.spark):
            counts.select(*HASH, "docs").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, self.paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """Sorted runs merged by outer joins, each hash once: two runs meet without an exchange.

        Not by a union and a sum: Spark 4.1 takes a union of bucketed scans for dealt
        by bucket where it isn't, and leaves a hash's parts apart.
        """
        both = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
        merge = lambda a, b: a.join(b.withColumnRenamed("docs", "more"), HASH, "full_outer").select(*HASH, both.alias("docs"))
        return reduce(merge, [self.spark.table(n) for n in names])

    def add(self, docs: DataFrame) -> None:
        """Counts the lines of one batch of documents, each row a document, and adds them as a run."""
        distinct = F.array_distinct(F.filter(keys_of(lines_of(F.col("text"))), lambda k: F.length(k) >= self.least_chars))
        counts = docs.select(F.explode(distinct).alias("key")).select(*hashed("key")).groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"))
        for name in (n for level in self.levels for n in level):
            counts = counts.join(self.spark.table(name).where(F.col("docs") >= self.least_docs), HASH, "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(full)))
            self._drop(full)
            level += 1

    def common(self) -> DataFrame:
        """(h1, h2) of the lines that enough documents hold, as a table of its own."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return kept(self._merged(names).where(F.col("docs") >= self.least_docs).select(*HASH))

    def close(self) -> None:
        self._drop(list(self.paths))
        self.levels = [[]]


def without_lines(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of docs(doc_id, text): all lines whose key is common are dropped, the others joined again.

    Null and empty texts are one empty line.  Rows that repeat doc_id and text are
    documents of their own with equal results; a null doc_id is as good as any.
    Other columns are not looked at; no rows give none.

    Lines travel as hashes: those that are common come back as positions, by
    document, and meet the texts in one join.  Both joins are between tables with
    an exchange each, so Spark splits a line or text that fills many rows, and
    broadcasts the common lines where they are few.
    """
    marks = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("m1"), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("m2")]
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.select(F.col("doc_id").isNull().alias("m0"), F.coalesce("doc_id", F.lit(0)).alias("m3"), *marks, "text", "doc_id")
    mark = ["m0", "m1", "m2", "m3"]
    placed = marked.select(*mark, F.posexplode(keys_of(lines_of(F.col("text")))).alias("at", "key")).where("key <> ''")
    hits = placed.select(*mark, "at", *hashed("key")).join(common, HASH).groupBy(*mark).agg(F.collect_set("at").alias("gone"))
    out = marked.join(kept(hits), mark, "left").select("doc_id", "gone", F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("lines", lines_of(F.col("text")))
    n = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))  # places are distinct, and stay in order
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", n.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), text.alias("kept_text"))


def drop_common_lines(batches: list[DataFrame], docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """docs without the lines that at least ``least_docs`` documents of all batches hold; see without_lines.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys
    shorter than ``least_chars`` code points (1 at least) count for nothing.
    """
    runs = Runs(docs.sparkSession, least_docs, max(1, least_chars))
    for batch in batches:
        runs.add(batch)
    common = runs.common()
    runs.close()
    return without_lines(docs, common)


def by_files(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """The rows of a table in batches of whole files, each read once; a table of one file is one batch."""
    files = sorted(docs.inputFiles())  # names alone
    n = max(1, min(batches, len(files)))
    return [docs.sparkSession.read.schema(docs.schema).parquet(*files[k::n]) for k in range(n)] if n > 1 else [docs]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = drop_common_lines(by_files(docs), docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
r AS (SELECT rid, count(*) AS n, count(c.key) AS gone, string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL) AS t FROM k LEFT JOIN c ON c.key = k.key GROUP BY rid)
SELECT doc_id, n AS n_lines, gone AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN r USING (rid)
"""
