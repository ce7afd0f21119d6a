"""Queries through files and tables of our own making: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquarry.engine.tables import fresh_path
from skyquarry.functions.ieee import rounded
from skyquarry.operators import fulltext
from skyquarry.operators import terrain as te
from skyquarry.plans.registry import query
from skyquarry.sources import geotiff, las, shapes
from skyquarry.streaming import timers
from skyquarry.streaming.merge import MergedTable, mirror


def _elevations(t, **options):
    path = fresh_path(t.spark)
    geotiff.write_geotiff(t.dem, path, ["z"], file=512, tile=64, levels=3, epsg=32632, originx=500000, originy=4100000, **options)
    return path


@query("s03_geotiff_window", "SELECT x, y, z FROM dem WHERE z IS NOT NULL AND x >= 30 AND x < 75 AND y > 12 AND y <= 490")
def _(t):
    return geotiff.read_geotiff(t.spark, _elevations(t)).where("x >= 30 AND x < 75 AND y > 12 AND y <= 490 AND b1 IS NOT NULL").selectExpr("x", "y", "b1 AS z")


_HALF = "SELECT floor(x / 2) AS x, floor(y / 2) AS y, avg(z) AS z FROM {} WHERE z IS NOT NULL GROUP BY 1, 2"


@query("k12_geotiff_overview", f"WITH a AS ({_HALF.format('dem')}), b AS ({_HALF.format('a')}) SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(z, 6) AS z FROM b")
def _(t):
    """The second overview: means of means."""
    return geotiff.read_geotiff(t.spark, _elevations(t), 2).where("b1 IS NOT NULL").select("x", "y", rounded(F.col("b1")).alias("z"))


_GREY = "CAST(floor(least(greatest(z / 120.0, 0.0), 1.0) * 255) AS INT)"


@query("k01_geotiff_rgb", f"SELECT x, y, {_GREY} AS r, 255 - {_GREY} AS g, CAST((x * 7 + y) % 256 AS INT) AS b FROM dem WHERE z IS NOT NULL")
def _(t):
    path = fresh_path(t.spark)
    shades = t.dem.where("z IS NOT NULL").selectExpr("x", "y", f"{_GREY} AS r", f"255 - {_GREY} AS g", "CAST((x * 7 + y) % 256 AS INT) AS b", "255 AS mask")
    geotiff.write_geotiff(shades, path, ["r", "g", "b", "mask"], file=512, tile=64, dtype="uint8")
    return geotiff.read_geotiff(t.spark, path).where("b4 = 255").selectExpr("x", "y", "CAST(b1 AS INT) AS r", "CAST(b2 AS INT) AS g", "CAST(b3 AS INT) AS b")


@query("f02_index_search", "SELECT p.id FROM project p LEFT JOIN (SELECT project_id, string_agg(lower(name), ' ') AS names FROM task GROUP BY 1) t ON t.project_id = p.id WHERE list_has_all(regexp_extract_all(lower(p.name) || ' ' || coalesce(names, ''), '[a-z0-9]+'), ['customer', 'urgent'])")
def _(t):
    """As f02_search_names, through an inverted index of all names; other forms of the words find the same."""
    names = t.task.where("name IS NOT NULL").groupBy("project_id").agg(F.array_join(F.array_distinct(F.collect_list("name")), " ").alias("names"))
    docs = t.project.join(names, F.col("id") == F.col("project_id"), "left").select("id", F.concat_ws(" ", "name", "names").alias("text"))
    index = fulltext.Index(t.spark, fresh_path(t.spark))
    index.apply(docs, 0)
    return index.search("urgently, the customers")


@query("k09_merged_batches", "SELECT id, name FROM project WHERE id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0")
def _(t):
    """A table kept by batches: rows, then changes of which a third deletes; the second is run twice."""
    table = MergedTable(t.spark, fresh_path(t.spark), "id bigint, name string", ["id"])
    table.apply(t.project.select("id", "name"), 0)
    for _ in range(2):
        table.apply(t.supplier.selectExpr("CAST(s_suppkey AS BIGINT) AS id", "s_name AS name"), 1, F.col("id") % 3 == 0)
    return table.read()


@query("j16_mirrored_listings", "SELECT project_id, id FROM task WHERE project_id % 2 = 1 AND id % 5 <> 0 UNION ALL SELECT project_id, id FROM task WHERE project_id % 2 = 0 AND id % 7 <> 0 AND project_id IN (SELECT project_id FROM task WHERE id % 7 <> 0) UNION ALL SELECT project_id, id FROM task WHERE project_id % 2 = 0 AND id % 5 <> 0 AND project_id NOT IN (SELECT project_id FROM task WHERE id % 7 <> 0)")
def _(t):
    """Files of projects by their listings: at first those of all, then of every other project again."""
    table = MergedTable(t.spark, fresh_path(t.spark), "project_id bigint, id bigint", ["project_id", "id"])
    tasks = t.task.selectExpr("CAST(project_id AS BIGINT) AS project_id", "CAST(id AS BIGINT) AS id")
    mirror(table, tasks.where("id % 5 <> 0"), 0, ["project_id"])
    mirror(table, tasks.where("project_id % 2 = 0 AND id % 7 <> 0"), 1, ["project_id"])
    return table.read()


@query(
    "t14_uploads_by_deadline",
    """WITH c AS (SELECT 'u' || user_id AS upload, 2 + user_id % 3 AS total, event_id % 4 AS idx, event_type AS data, CAST(floor(epoch_ms(CAST(ts AS TIMESTAMP))) AS BIGINT) AS ms FROM events),
    e AS (SELECT upload, min(ms) + 36000000 AS last, max(total) AS total FROM c GROUP BY 1),
    p AS (SELECT e.upload, e.total, idx, min(data) AS data FROM c JOIN e ON c.upload = e.upload AND ms <= last GROUP BY ALL)
    SELECT upload, CASE WHEN count(*) = total THEN string_agg(data, '' ORDER BY idx) END AS data, count(*) = total AS complete FROM p GROUP BY upload, total""",
)
def _(t):
    chunks = t.events.selectExpr("'u' || user_id AS upload", "2 + user_id % 3 AS total", "event_id % 4 AS idx", "event_type AS data", "ts")
    return timers.assembled_by(chunks, "10 hours")


@query("s18_shapefile_overlay", "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, c_name AS name, c_acctbal / 100 AS x0, CAST(c_nationkey AS DOUBLE) AS y0, 5 AS n FROM customer")
def _(t):
    """Rectangles of all customers as a layer of polygons, read back record by record."""
    corner = lambda i, j: F.struct((F.col("c_acctbal") / 100 + 7.0 * i).alias("x"), (F.col("c_nationkey") + 5.0 * j).alias("y"))
    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))
    path = fresh_path(t.spark)
    shapes.write_shapefile(t.customer.select(F.array(ring).alias("parts"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_name").alias("name")), path, shapes.POLYGON)
    first = F.col("parts")[0][0]
    return shapes.read_shapefile(t.spark, path).select("id", "nation", "name", first["x"].alias("x0"), first["y"].alias("y0"), F.size(F.col("parts")[0]).alias("n"))


@query("k03_contour_shapefile")
def _(t):
    """Contour lines as a layer of lines with their level."""
    lines = te.contour_lines(te.contour_segments(t.dem, 100.0), shortest=1.0)
    path = fresh_path(t.spark)
    shapes.write_shapefile(lines.select(F.array(F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("parts"), "level", "length"), path)
    return shapes.read_shapefile(t.spark, path).select("level", F.round("length", 4).alias("length"), F.size(F.col("parts")[0]).alias("n"))


@query("k02_las_cloud", "SELECT x, y, z, count(*) AS n FROM (SELECT round(CAST(l_quantity AS DOUBLE), 3) AS x, round(CAST(l_discount * 100 AS DOUBLE), 3) AS y, CAST(floor(l_extendedprice) AS DOUBLE) AS z FROM lineitem) GROUP BY x, y, z")
def _(t):
    """All lines as points, written as scaled integers and read back."""
    points = t.lineitem.selectExpr("CAST(l_quantity AS DOUBLE) AS x", "CAST(l_discount * 100 AS DOUBLE) AS y", "CAST(floor(l_extendedprice) AS DOUBLE) AS z")
    path = fresh_path(t.spark)
    las.write_las(points, path)
    back = las.read_las(t.spark, path).select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("z", 3).alias("z"))
    return back.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
