"""Tables that streams keep up to date: micro-batches merged by key, with the same result however often one is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyquarry.engine.tables import removed, tidy


#: Tasks that write one partition, each a file of its own.
WRITERS = 8


class MergedTable:
    """Rows by key, in ``parts`` partitions by the key's hash; a batch rewrites the partitions that it touches, as a version of its own.

    ``path/data/v=<batch>/part=<p>`` holds a partition as of a batch, and
    ``path/log/v=<batch>`` says which it wrote; a version counts once its log is
    there.  A batch starts from the versions before its number, so a replay after a
    failure writes what it wrote before.  Batches come in the order of their numbers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], parts: int = 16):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, keys, parts
        self.columns = spark.createDataFrame([], schema).columns

    def part_of(self, *keys: Column | str) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.parts)).cast("int")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The latest version of each partition: as many rows as there are partitions."""
        if not self._exists(f"{self.path}/log"):
            return {}
        log = self.spark.read.schema("part int, v bigint").parquet(f"{self.path}/log")
        log = log if before is None else log.where(F.col("v") < before)
        return {r["part"]: r["v"] for r in log.groupBy("part").agg(F.max("v").alias("v")).collect()}

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows as of the latest batch, or of the one before; of some partitions only, if given."""
        paths = [f"{self.path}/data/v={v}/part={p}" for p, v in sorted(self.versions(before).items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, changes: DataFrame, batch: int, deleted: Column | None = None, order: list[str] | None = None) -> None:
        """Merges the batch's changes: the last one of a key by ``order`` (any, without) replaces or deletes its row.

        Rows with a null key are kept like others.  A batch without changes writes
        nothing; one that was applied before changes nothing, as long as no later one
        was applied since.
        """
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        rows = changes.select(*self.columns, gone.alias("_gone"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])))
        last = F.struct(*(f"_o{k}" for k in range(len(order or []))), "_gone", *(c for c in self.columns if c not in self.keys))
        latest = rows.groupBy(*self.keys).agg(F.max(last).alias("_l"))
        latest = latest.select(*(F.col(c) if c in self.keys else F.col(f"_l.{c}").alias(c) for c in self.columns), F.col("_l._gone").alias("_gone"), self.part_of().alias("part"))
        latest = latest.persist()  # a copy that is lost is made again
        try:
            touched = [r["part"] for r in latest.select("part").distinct().collect()]  # at most ``parts``
            if not touched:
                return
            named = latest.select(*(F.col(k).alias(f"_{k}") for k in self.keys))
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
            base = self.read(batch, touched).join(named, same, "left_anti")
            merged = base.unionByName(latest.where(~F.col("_gone")).select(*self.columns)).withColumn("part", self.part_of())
            with tidy(self.spark):
                merged.repartition(F.col("part"), F.pmod(F.xxhash64(F.lit(3), *self.keys), F.lit(WRITERS))).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/v={batch}")
            for p in touched:  # a partition that has become empty has a folder all the same
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/v={batch}/part={p}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)
            log = self.spark.createDataFrame([(p, batch) for p in touched], "part int, v bigint")
            log.select("part", "v").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/v={batch}")
        finally:
            latest.unpersist()

    def vacuum(self) -> None:
        """Removes versions that no partition is read from any more; batches before the latest can't be replayed after it."""
        used = set(self.versions().values())
        log = self.spark.read.schema("part int, v bigint").parquet(f"{self.path}/log")
        for r in log.select("v").distinct().collect():  # one a batch since the last vacuum
            if r["v"] not in used:
                removed(self.spark, f"{self.path}/data/v={r['v']}")
                removed(self.spark, f"{self.path}/log/v={r['v']}")

    def follow(self, changes: DataFrame, checkpoint: str, deleted: Column | None = None, order: list[str] | None = None, every: str | None = None, into: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """A query that merges a stream of changes; without ``every`` it takes what is there and stops."""
        step = into or (lambda df, batch: self.apply(df, batch, deleted, order))
        writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def mirror(table: MergedTable, listings: DataFrame, batch: int, scope: list[str]) -> dict[str, int]:
    """A two-way difference: makes the table's rows of every scope that a batch of full listings names equal to them.

    What is new is inserted, what is missing is deleted; scopes that the batch
    doesn't name stay.  ``scope`` are columns of the table.  Counts of both are
    returned; a batch that is run again finds the same.
    """
    keys = table.keys
    before = table.read(batch).join(listings.select(*scope).distinct(), scope, "left_semi")
    new = listings.select(*table.columns).join(before.select(*keys), keys, "left_anti").dropDuplicates(keys)
    gone = before.join(listings.select(*keys).distinct(), keys, "left_anti")
    changes = new.withColumn("_del", F.lit(False)).unionByName(gone.withColumn("_del", F.lit(True)))
    counts = changes.groupBy().agg(F.count_if(~F.col("_del")).alias("inserted"), F.count_if("_del").alias("deleted")).first().asDict()
    table.apply(changes, batch, F.col("_del"))
    return counts
