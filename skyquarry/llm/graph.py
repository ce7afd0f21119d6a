"""Connected components and joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquarry.llm.text import tabled, fresh

#: A frequent key's rows are dealt over so many tasks.
SALTS = 64
#: Members of a bucket that one round compares with all others.
CENTRES = 1 << 10


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[Column | str], how: str = "inner", count: str | None = None) -> DataFrame:
    """rows joined to facts (one row a key at most), without a task that gets all rows of a key.

    A row's salt is a hash of ``by``; a key's facts are repeated for the salts that
    its rows have, so at most once a row.  Only sets of salts are gathered by key,
    pre-aggregated in each task.  count: also the number of rows with the row's key.
    how: inner or left; null keys match nothing and are spread like others.
    """
    salt, salts = fresh(rows, "salt", "salts")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(F.lit(7), *by), F.lit(SALTS)))
    known = salted.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.collect_set(salt).alias(salts), *([F.count(F.lit(1)).alias(count)] if count else []))
    spread = known.join(facts, keys, "left" if count else "inner").withColumn(salt, F.explode(salts)).drop(salts)
    return salted.join(spread, [*keys, salt], how).drop(salt)


def _starred(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included, joined back to its edges: (u, v, m)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")  # a hub's edges, two numbers each, can be split: the other side has one row a node


def connected_components(edges: DataFrame, a: str, b: str, node_type: str = "bigint") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Alternating large-star and small-star steps.  Neither edges nor labels reach the
    driver: only a count and a checksum that tell when nothing changes any more.
    Each round is tabled.  Loops and repeated edges change nothing; edges with
    a null end are left out.
    """
    now = edges.select(F.col(a).cast(node_type).alias("u"), F.col(b).cast(node_type).alias("v")).where("u is not null and v is not null")
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = tabled(now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = _starred(small)
        own = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = tabled(own.where("u <> v").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def components_of_buckets(members: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) of members(bucket, node): components of the verified pairs among members of a bucket.

    verified takes pairs (a, b) and returns those that are linked.  In round k some
    2**k members of every bucket that still holds several components (CENTRES at
    most) are compared with its members of other components, and then leave it.  It
    ends when no bucket is mixed, so no link between two members of a bucket is lost
    and no task ever holds a bucket.  What is linked is compared once; a bucket of n
    members that are not linked takes log2(n) rounds, and n / CENTRES beyond that.
    """
    labels = tabled(members.select("node", F.col("node").alias("label")).distinct())
    step = 0
    while True:
        rows = members.join(labels, "node").withColumn("h", F.xxhash64("node", F.lit(step)))
        mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("h").alias("first")).where("lo < hi")
        share = F.lit(float(min(1 << step, CENTRES))) / F.col("n")
        centre = (F.col("h") == F.col("first")) | ((F.col("h").cast("double") / 2.0**64 + 0.5) < share)
        rows = spread_join(rows, mixed.select("bucket", "n", "first"), ["bucket"], ["node"])
        rows = tabled(rows.select("bucket", "node", "label", centre.alias("centre")))
        if rows.isEmpty():
            return labels
        centres = rows.where("centre").groupBy("bucket").agg(F.collect_list(F.struct("node", "label")).alias("centres"))
        pairs = spread_join(rows, centres, ["bucket"], ["node"]).withColumn("c", F.explode("centres"))
        pairs = pairs.where("c.label <> label and not (centre and c.node > node)").select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        found = tabled(verified(pairs))
        members = rows.where("not centre").select("bucket", "node")
        step += 1
        if found.isEmpty():
            continue
        named = found.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        merged = connected_components(tabled(named.select("la", "lb").distinct()), "la", "lb")
        labels = tabled(spread_join(labels, merged.withColumnRenamed("node", "label"), ["label"], ["node"], "left").select("node", F.coalesce("component", "label").alias("label")))
