"""Queries on the life of tasks, on event streams, and on what is read and written."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquarry.functions import color
from skyquarry.functions.ieee import rounded
from skyquarry.operators import catalog, raster
from skyquarry.operators import lifecycle as li
from skyquarry.plans.catalog import GRANTS_SQL, grants
from skyquarry.plans.registry import query
from skyquarry.sources import files, sinks, store

NOW = "TIMESTAMP '2001-01-01'"


def _now():
    return F.lit("2001-01-01").cast("timestamp")


@query("t01_pending", "SELECT id FROM task WHERE NOT partial AND ((node_id IS NULL AND auto_node) OR (node_id IS NOT NULL AND (status IS NULL OR status IN (10, 20))) OR pending_action IS NOT NULL)")
def _(t):
    return t.task.where(li.pending()).select("id")


@query(
    "t02_next_state",
    """WITH s AS (SELECT t.*, coalesce(n.minutes_ago <= 5, false) AS online, CASE WHEN t.id % 2 = 0 THEN 40 END AS reported FROM task t LEFT JOIN node n ON t.node_id = n.id),
    a AS (SELECT *, node_id IS NOT NULL AND auto_node AND coalesce(status NOT IN (30, 50), true) AND NOT online AS away FROM s)
    SELECT id, CASE WHEN pending_action = 1 THEN 50 WHEN pending_action = 3 THEN NULL WHEN away AND status = 20 THEN 30 WHEN node_id IS NOT NULL AND status IS NULL THEN 10
                    WHEN status IN (10, 20) THEN coalesce(reported, status) ELSE status END AS status,
           CASE WHEN pending_action = 2 THEN 2 END AS pending_action,
           CASE WHEN away AND status = 20 AND coalesce(pending_action NOT IN (1, 3), true) THEN 'Processing node went offline' END AS error FROM a""",
)
def _(t):
    n = t.node.select(F.col("id").alias("n"), "minutes_ago")
    rows = t.task.join(n, F.col("node_id") == F.col("n"), "left")
    out = li.next_state(F.coalesce(F.col("minutes_ago") <= 5, F.lit(False)), F.when(F.col("id") % 2 == 0, F.lit(40)))
    return rows.select("id", *(out[k].alias(k) for k in ("status", "pending_action", "error")))


@query("t03_best_nodes", "WITH g AS (SELECT DISTINCT o.id AS user_id, n.id AS node_id, queue_count FROM owner o JOIN node n ON n.owner_id % 5 = o.id % 5 WHERE coalesce(minutes_ago < 5, false)) SELECT user_id, arg_min(node_id, (queue_count, node_id)) AS node_id FROM g GROUP BY 1")
def _(t):
    own = t.owner.select(F.col("id").alias("user_id"), (F.col("id") % 5).alias("k"))
    may = t.node.select(F.col("id").alias("object_id"), (F.col("owner_id") % 5).alias("k")).join(own, "k")
    return li.best_nodes(t.node, may)


@query("t04_offline", "SELECT t.id, t.status = 20 AS fails FROM task t LEFT JOIN node n ON t.node_id = n.id WHERE t.node_id IS NOT NULL AND auto_node AND status IN (10, 20) AND NOT coalesce(minutes_ago <= 5, false)")
def _(t):
    n = t.node.where(F.coalesce(F.col("minutes_ago") <= 5, F.lit(False))).select(F.col("id").alias("n"))
    rows = t.task.where(F.col("node_id").isNotNull() & F.col("auto_node") & F.col("status").isin(10, 20))
    return rows.join(n, F.col("node_id") == F.col("n"), "left_anti").select("id", (F.col("status") == 20).alias("fails"))


@query("t05_expired_partial", f"SELECT id FROM task WHERE partial AND created_at <= {NOW} - INTERVAL 72 HOUR")
def _(t):
    return li.expired_partial(t.task, _now()).select("id")


@query("t06_removable_projects", "SELECT id FROM project WHERE deleting AND id NOT IN (SELECT project_id FROM task WHERE status = 40)")
def _(t):
    return li.removable_projects(t.project, t.task.where("status = 40")).select("id")


@query(
    "t07_over_quota",
    """WITH x AS (SELECT t.id, p.owner_id, t.created_at, t.size FROM task t JOIN project p ON t.project_id = p.id), q AS (SELECT owner_id, sum(greatest(quota, 0)) * 60 AS quota FROM project GROUP BY 1),
    u AS (SELECT x.owner_id, sum(size) - max(q.quota) AS excess FROM x JOIN q USING (owner_id) GROUP BY 1),
    r AS (SELECT x.id, x.owner_id, excess, sum(size) OVER (PARTITION BY x.owner_id ORDER BY created_at DESC, x.id DESC ROWS UNBOUNDED PRECEDING) - size AS before FROM x JOIN u ON x.owner_id = u.owner_id WHERE excess > 0)
    SELECT id, owner_id FROM r WHERE before < excess""",
)
def _(t):
    tasks = t.task.join(t.project.select(F.col("id").alias("p"), "owner_id"), F.col("project_id") == F.col("p")).select("id", "owner_id", "created_at", "size")
    quotas = t.project.groupBy("owner_id").agg((F.sum(F.greatest("quota", F.lit(0.0))) * 60).alias("quota"))
    return catalog.over_quota_tasks(tasks, quotas).select("id", "owner_id")


@query("t08_stale_files", f"SELECT event_id FROM events WHERE CASE WHEN event_type = 'view' THEN epoch({NOW}) - epoch(ts) > 30 * 86400 ELSE epoch({NOW}) - epoch(ts) > 86400 END")
def _(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") == "view", "/media/cache/x").otherwise("/media/tmp/x").alias("path"), F.col("ts").alias("modified"))
    return li.stale_files(rows, _now()).select("event_id")


@query(
    "t11_throttled",
    """WITH RECURSIVE o AS (SELECT task_id, event_id, epoch_us(ts) AS at, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS k FROM life WHERE ts IS NOT NULL),
    j AS (SELECT a.task_id, a.k, min(b.k) AS next FROM o a JOIN o b ON a.task_id = b.task_id AND b.k > a.k AND b.at - a.at >= 21600000000 GROUP BY ALL),
    r AS (SELECT task_id, k FROM o WHERE k = 1 UNION ALL SELECT j.task_id, j.next FROM r JOIN j ON r.task_id = j.task_id AND r.k = j.k)
    SELECT o.task_id, event_id FROM r JOIN o ON r.task_id = o.task_id AND r.k = o.k""",
)
def _(t):
    return li.throttled(t.life, 6 * 3600.0).select("task_id", "event_id")


@query(
    "t12_signals",
    """SELECT signal, count(*) AS n FROM (SELECT unnest([CASE WHEN partial THEN 'task_duplicated' END, CASE WHEN pending_action = 4 THEN 'task_resizing_images' END, CASE WHEN status = 40 THEN 'task_completed' END,
    CASE WHEN status = 30 THEN 'task_failed' END, CASE WHEN pending_action = 2 THEN 'task_removing' END, CASE WHEN pending_action = 2 THEN 'task_removed' END, CASE WHEN node_id IS NULL THEN 'processing_node_removed' END]) AS signal FROM task)
    WHERE signal IS NOT NULL GROUP BY 1""",
)
def _(t):
    sent = li.task_signals(F.lit(20), F.col("status"), F.col("pending_action"), F.col("partial"), F.col("node_id").isNull())
    return t.task.select(F.explode(sent).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query("t13_appended_lines", "SELECT task_id, string_agg(kind, chr(10) ORDER BY ts, event_id) AS log FROM life GROUP BY 1")
def _(t):
    lines = F.sort_array(F.collect_list(F.struct("ts", "event_id", "kind")))
    return t.life.groupBy("task_id").agg(F.array_join(F.transform(lines, lambda x: x["kind"]), "\n").alias("log"))


@query("t14_assembled_uploads", "SELECT task_id AS upload, string_agg(kind, '' ORDER BY event_id) AS data FROM life GROUP BY 1 HAVING count(*) = 9")
def _(t):
    rows = t.life.select(F.col("task_id").alias("upload"), F.lit(9).cast("bigint").alias("total"), F.col("event_id").alias("idx"), F.col("kind").alias("data"))
    return li.assembled(rows)


@query("t15_retries", "SELECT task_id, count(*) FILTER (kind = 'error') < 5 AS again FROM life GROUP BY 1")
def _(t):
    return t.life.groupBy("task_id").agg(li.retries_left(F.count_if(F.col("kind") == "error")).alias("again"))


@query("t16_cached_usage", "SELECT p.owner_id, round(sum(t.size), 2) AS used FROM task t JOIN project p ON t.project_id = p.id GROUP BY 1")
def _(t):
    """Asked for twice within the half hour: the second answer is the table that the first one left."""

    def used():
        by_project = t.task.groupBy("project_id").agg(F.sum("size").alias("size"))
        return t.project.join(by_project, F.col("id") == F.col("project_id")).groupBy("owner_id").agg(rounded(F.sum("size"), 2).alias("used"))

    path = sinks.scratch(t.spark, "usage")
    store.cached(t.spark, path, used, 1000)
    return store.cached(t.spark, path, lambda: used().where("false"), 2799)


@query("e05_typed_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS int_value, json_extract_string(props, '$.none') AS string_value FROM life")
def _(t):
    p = F.from_json("props", "k bigint, none string")
    return t.life.select("event_id", p["k"].alias("int_value"), p["none"].alias("string_value"))


@query("s13_task_statistics", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 10 AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS points, p_retailprice AS area FROM part")
def _(t):
    c = lambda x: F.col(x).cast("string")
    text = F.concat(
        F.lit('{"point_cloud_statistics":{"dense":'), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit(',"stats":{"statistic":[{"count":'), (F.col("p_size") * 10).cast("string"),
        F.lit('}]}},"reconstruction_statistics":{"reconstructed_points_count":'), c("p_size"), F.lit('},"processing_statistics":{"area":'), c("p_retailprice"), F.lit("}}"),
    )
    s = files.task_statistics(text)
    return t.part.select("p_partkey", s["points"].alias("points"), s["area"].alias("area"))


@query("s10_point_cloud", "SELECT count(*) AS n, round(min(l_quantity), 4) AS x0, round(max(l_extendedprice), 4) AS y1 FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l_quantity"), 4).alias("x0"), F.round(F.max("l_extendedprice"), 4).alias("y1"))


@query("s11_georeferenced", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN true ELSE s_suppkey % 3 <> 0 END AS ok FROM supplier")
def _(t):
    srs = F.when(F.col("s_suppkey") % 3 != 0, F.lit("EPSG:32615"))
    return t.supplier.select("s_suppkey", files.georeferenced(srs, F.col("s_suppkey") % 4 == 0).alias("ok"))


_BYTES = "CAST(floor(greatest(least(z, 400), 0) * 255 / 400) AS INT)"


@query("k01_exported_pixels", f"SELECT y, x, {_BYTES} AS v FROM dem WHERE z IS NOT NULL")
def _(t):
    """Written in blocks and read back."""
    path = sinks.scratch(t.spark, "raster")
    sinks.export_raster(t.dem.where("z IS NOT NULL").select("y", "x", raster.to_byte(raster.rescale(F.col("z"), 0.0, 400.0)).alias("v")), path, 64)
    return t.spark.read.parquet(path).select("y", "x", "v")


@query("k01_exported_image", f"SELECT x, y, {_BYTES} AS r, 255 - {_BYTES} AS g, CAST(x % 256 AS INT) AS b FROM dem WHERE z IS NOT NULL")
def _(t):
    """RGB images with a transparent gap, drawn and decoded."""
    v = raster.to_byte(raster.rescale(F.col("z"), 0.0, 400.0))
    rows = t.dem.select("x", "y", v.alias("r"), (255 - v).alias("g"), (F.col("x") % 256).cast("int").alias("b"))
    return sinks.read_tiles(sinks.render_tiles(rows, 64, ("r", "g", "b")), ("r", "g", "b"))


_PALETTE = color.PALETTES["discrete_ndvi"]
_CHANNEL = lambda k: "[" + ", ".join(str(int(c[1 + 2 * k : 3 + 2 * k], 16)) for c in _PALETTE) + f"][CAST(least(floor(CAST({_BYTES} AS DOUBLE) / 256 * {len(_PALETTE)}), {len(_PALETTE) - 1}) AS INT) + 1]"


@query("k05_coloured_tiles", f"SELECT x, y, {_CHANNEL(0)} AS r, {_CHANNEL(1)} AS g, {_CHANNEL(2)} AS b FROM dem WHERE z IS NOT NULL")
def _(t):
    tiles = sinks.map_tiles(t.dem, F.col("z"), 0.0, 400.0, _PALETTE, size=64)
    return sinks.read_tiles(tiles, ("r", "g", "b"))


@query("k05_shaded_tiles")
def _(t):
    from skyquarry.operators import terrain

    tiles = sinks.map_tiles(terrain.hillshade(t.dem), F.col("z"), 0.0, 400.0, _PALETTE, F.col("shade"), 64)
    return sinks.read_tiles(tiles, ("r", "g", "b"))


@query("k05_rendered_tiles", f"SELECT x, y, {_BYTES} AS v FROM dem WHERE z IS NOT NULL")
def _(t):
    rows = t.dem.select("x", "y", raster.to_byte(raster.rescale(F.col("z"), 0.0, 400.0)).alias("v"))
    return sinks.read_tiles(sinks.render_tiles(rows, 64))


@query("k03_contour_features")
def _(t):
    from skyquarry.operators import terrain

    return sinks.geojson_features(terrain.contour_lines(terrain.contour_segments(t.dem, 200.0)))


@query("k08_dump_rows", "SELECT owner_id, count(*) AS n, min(name) AS first FROM project GROUP BY 1")
def _(t):
    return t.project.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@query("t03_user_permissions", f"WITH {GRANTS_SQL} SELECT user_id, count(*) AS n FROM grants WHERE permission = 'view' GROUP BY 1")
def _(t):
    return grants(t).where("permission = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
