"""The domain's relations as views over the input tables.

A view is a list of SQL expressions over one table, valid in Spark and in any
engine with ANSI casts, so that an oracle sees exactly the same relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: name: (table, columns). Statuses: 20 running, 30 failed, 40 completed, null not started.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "dem": (
        "events",
        [
            "CAST(floor(event_id / 100) AS BIGINT) AS y",
            "CAST(event_id % 100 AS BIGINT) AS x",
            "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS z",
        ],
    ),
    "ortho": (
        "lineitem",
        [
            "l_linestatus AS raster",
            "l_discount AS r",
            "CAST(l_quantity / 50 AS DOUBLE) AS g",
            "CAST(l_extendedprice / 105000 AS DOUBLE) AS b",
            "l_tax AS n",
            "CAST((l_discount + l_tax) / 2 AS DOUBLE) AS re",
            "CAST(l_quantity / 50 AS DOUBLE) AS l",
            "CASE WHEN l_returnflag = 'R' THEN 0 ELSE 255 END AS alpha",
        ],
    ),
    "task": (
        "orders",
        [
            "o_orderkey AS id",
            "o_custkey AS project_id",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Task ' || o_orderpriority END AS name",
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 30 WHEN o_orderstatus = 'O' THEN 20 ELSE 40 END AS status",
            "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 100 + 1 END AS node_id",
            "CASE WHEN o_orderkey % 17 = 0 THEN CAST(o_orderkey % 6 + 1 AS INT) END AS pending_action",
            "o_orderkey % 4 = 0 AS auto_node",
            "o_orderkey % 9 = 0 AS partial",
            "o_orderkey % 8 = 0 AS public",
            "o_orderdate AS created_at",
            "o_totalprice AS size",
            "CAST(floor(o_totalprice * 100) AS BIGINT) - 1 AS processing_time",
            "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'orthophoto.tif,dsm.tif,georeferenced_model.laz' WHEN '2' THEN 'orthophoto.tif,dtm.tif'"
            " WHEN '3' THEN 'dsm.tif, dtm.tif,georeferenced_model.laz' WHEN '4' THEN 'georeferenced_model.laz' ELSE '' END AS assets",
            "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent d .hidden' WHEN '2' THEN 'high e' WHEN '3' THEN ' d  e ' ELSE '' END AS tags",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 360 - 180 AS DOUBLE) END AS ox",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 360 - 180 AS DOUBLE) END AS dx",
            "CAST(o_custkey % 170 - 85 AS DOUBLE) AS y0",
        ],
    ),
    "project": (
        "customer",
        [
            "c_custkey AS id",
            "CAST(c_nationkey AS BIGINT) AS owner_id",
            "c_name AS name",
            "c_mktsegment AS description",
            "CASE WHEN c_custkey % 3 = 0 THEN '.hidden ' || lower(c_mktsegment) ELSE lower(c_mktsegment) || ' all' END AS tags",
            "c_custkey % 10 = 0 AS deleting",
            "c_custkey % 7 = 0 AS public",
            "c_acctbal AS quota",
        ],
    ),
    "owner": ("nation", ["CAST(n_nationkey AS BIGINT) AS id", "n_name AS username", "lower(n_name) || '@' || CAST(n_regionkey AS STRING) || '.test' AS email"]),
    "node": (
        "supplier",
        [
            "s_suppkey AS id",
            "CAST(s_nationkey AS BIGINT) AS owner_id",
            "s_name AS hostname",
            "CAST(floor(s_acctbal / 500) AS BIGINT) AS queue_count",
            "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 12 END AS minutes_ago",
            "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS label",
        ],
    ),
    "life": ("events", ["event_id", "ts", "user_id AS task_id", "event_type AS kind", "value", "props"]),
}


class Tables:
    """Input tables and views by name; columns that a query doesn't use are never read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            table, columns = VIEWS[name]
            return getattr(self, table).selectExpr(*columns)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """The statement with the views that it names as common table expressions."""
    used = [v for v in VIEWS if any(v == w for w in _words(sql))]
    if not used:
        return sql
    parts = ", ".join(f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {VIEWS[v][0]})" for v in used)
    own = sql.lstrip()
    if own[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {parts}, {own[14:]}"
    return f"WITH {parts}, {own[5:]}" if own[:5].upper() == "WITH " else f"WITH {parts} {own}"


def _words(sql: str) -> set[str]:
    out, word = set(), ""
    for c in sql + " ":
        if c.isalnum() or c == "_":
            word += c
        else:
            out.add(word)
            word = ""
    return out
