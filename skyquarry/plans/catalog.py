"""Queries on projects, tasks, nodes and users."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyquarry.functions.ieee import rounded
from skyquarry.operators import catalog as c
from skyquarry.plans.registry import query


@query("s01_table_scan", "SELECT id, project_id, status FROM task")
def _(t):
    return t.task.select("id", "project_id", "status")


@query("s02_point_lookup", "SELECT id, name, owner_id FROM project WHERE id = 42")
def _(t):
    return t.project.where(F.col("id") == 42).select("id", "name", "owner_id")


@query("p01_equality", "SELECT id FROM task WHERE status = 40 AND project_id = 77")
def _(t):
    return c.matching(t.task, {"status": 40, "project_id": 77}).select("id")


@query("p02_has_assets", "SELECT id FROM task WHERE list_has_all(list_transform(split(assets, ','), lambda x: trim(x)), ['georeferenced_model.laz', 'dsm.tif'])")
def _(t):
    return c.with_assets(t.task, "georeferenced_model.laz, dsm.tif,").select("id")


@query("p03_box", "SELECT id FROM task WHERE coalesce(ox <= 20 AND ox + 2 >= -10 AND y0 <= 30 AND y0 + 2 >= 0, false) OR coalesce(dx <= 20 AND dx + 2 >= -10 AND y0 <= 30 AND y0 + 2 >= 0, false)")
def _(t):
    box, y = c.parse_box("-10,0,20,30"), F.col("y0")
    return t.task.where(c.overlaps(box, F.col("ox"), y, F.col("ox") + 2, y + 2) | c.overlaps(box, F.col("dx"), y, F.col("dx") + 2, y + 2)).select("id")


@query("p04_user_exact", "SELECT p.id FROM project p JOIN owner o ON p.owner_id = o.id WHERE lower(username) = 'france'")
def _(t):
    return c.search_projects(t.project, t.task, t.owner, "@FrAnCe @other").select("id")


@query("p05_prefix", "SELECT id FROM owner WHERE starts_with(lower(username), 'in') OR starts_with(lower(email), 'in')")
def _(t):
    return c.starts_with_either(t.owner, "IN", "username", "email").select("id")


@query("p06_null_disjunction", "SELECT id FROM task WHERE ox IS NOT NULL OR dx IS NOT NULL")
def _(t):
    return t.task.where(F.col("ox").isNotNull() | F.col("dx").isNotNull()).select("id")


@query("p07_in_list", "SELECT id FROM task WHERE status IN (20, 30)")
def _(t):
    return t.task.where(F.col("status").isin(20, 30)).select("id")


@query("p08_time_range", "SELECT id FROM task WHERE created_at >= TIMESTAMP '1998-07-01' - INTERVAL 72 HOUR AND created_at <= TIMESTAMP '1998-07-01'")
def _(t):
    now = F.lit("1998-07-01").cast("timestamp")
    return t.task.where((F.col("created_at") >= now - F.expr("INTERVAL 72 HOURS")) & (F.col("created_at") <= now)).select("id")


@query("p09_extensions", r"SELECT page_id FROM pages WHERE lower(regexp_extract(url, '(\.[^./?#]+)([?#].*)?$', 1)) IN ('.html', '.txt')")
def _(t):
    return t.pages.where(F.lower(F.regexp_extract("url", r"(\.[^./?#]+)([?#].*)?$", 1)).isin(".html", ".txt")).select("page_id")


@query("p10_owner_or_public", "SELECT id FROM project WHERE owner_id = 7 OR public")
def _(t):
    return t.project.where((F.col("owner_id") == 7) | F.col("public")).select("id")


@query("p11_empty_json", "SELECT event_id FROM life WHERE coalesce(props, '{}') = '{}'")
def _(t):
    return t.life.where(F.size(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))) == 0).select("event_id")


@query("p12_filter_set", "SELECT id FROM task WHERE status IS NULL AND partial = false")
def _(t):
    return c.matching(t.task, {"status": None, "partial": False}).select("id")


@query("p13_year", "SELECT id FROM task WHERE year(created_at) = 1997")
def _(t):
    return t.task.where(c.in_year("created_at", 1997)).select("id")


@query("p14_exclude_columns", "SELECT id, name, owner_id, description, tags, public, quota FROM project")
def _(t):
    return t.project.drop("deleting")


@query("p15_computed_columns", "SELECT id, CASE WHEN label = '' THEN hostname ELSE label END AS shown FROM node")
def _(t):
    return t.node.select("id", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("hostname")).alias("shown"))


@query("p16_first_extent", "SELECT id, coalesce(ox, dx, y0) AS x FROM task")
def _(t):
    return t.task.select("id", F.coalesce("ox", "dx", "y0").alias("x"))


@query("p17_online", "SELECT id, coalesce(minutes_ago <= 5, false) AS online FROM node")
def _(t):
    return t.node.select("id", F.coalesce(F.col("minutes_ago") <= 5, F.lit(False)).alias("online"))


@query("p18_name_and_tags", "SELECT id FROM task WHERE contains(lower(coalesce(name, 'Task #' || id)), 'task') AND list_has_all(split(tags, ' '), ['d', 'e'])")
def _(t):
    name = F.coalesce("name", F.concat(F.lit("Task #"), F.col("id").cast("string")))
    return t.task.where(F.contains(F.lower(name), F.lit("task")) & c.has_all(F.split("tags", " "), ["d", "e"])).select("id")


@query("p19_visible_tags", "SELECT tags, array_to_string(list_filter(split(tags, ' '), lambda x: x <> '' AND NOT starts_with(x, '.')), ' ') AS shown, array_to_string(list_filter(split(tags, ' '), lambda x: starts_with(x, '.')), ' ') AS hidden, count(*) AS n FROM task GROUP BY ALL")
def _(t):
    parts = F.split("tags", " ")
    rows = t.task.groupBy("tags").agg(F.count(F.lit(1)).alias("n"))
    shown = F.array_join(F.filter(parts, lambda x: (x != "") & ~x.startswith(".")), " ")
    return rows.select("tags", shown.alias("shown"), F.array_join(F.filter(parts, lambda x: x.startswith(".")), " ").alias("hidden"), "n")


GRANTS_SQL = "grants AS (SELECT id AS object_id, owner_id AS user_id, 'view' AS permission FROM project UNION ALL SELECT id, (owner_id + 1) % 25, 'view' FROM project WHERE NOT deleting UNION ALL SELECT id, owner_id, 'delete' FROM project)"


def grants(t):
    p = t.project
    return (
        p.selectExpr("id AS object_id", "owner_id AS user_id", "'view' AS permission")
        .unionAll(p.where("NOT deleting").selectExpr("id", "(owner_id + 1) % 25", "'view'"))
        .unionAll(p.selectExpr("id", "owner_id", "'delete'"))
    )


@query("p21_public_or_permitted", f"WITH {GRANTS_SQL} SELECT t.id FROM task t JOIN project p ON t.project_id = p.id WHERE t.public OR p.public OR p.id IN (SELECT object_id FROM grants WHERE user_id = 3 AND permission = 'view')")
def _(t):
    mine = c.allowed(t.project, grants(t), F.lit(3), "view").select(F.col("id").alias("m"))
    p = t.project.select(F.col("id").alias("p"), F.col("public").alias("p_public"))
    rows = t.task.join(p, F.col("project_id") == F.col("p")).join(mine, F.col("p") == F.col("m"), "left")
    return rows.where(F.col("public") | F.col("p_public") | F.col("m").isNotNull()).select("id")


@query("p22_item_flags", "SELECT id, coalesce(status = 30, false) AS failed, coalesce(status IN (20, 30, 40), false) AS started, coalesce(status = 40, false) AND assets <> '' AS exportable FROM task")
def _(t):
    s = F.col("status")
    flag = lambda x: F.coalesce(x, F.lit(False))
    return t.task.select("id", flag(s == 30).alias("failed"), flag(s.isin(20, 30, 40)).alias("started"), (flag(s == 40) & (F.col("assets") != "")).alias("exportable"))


@query("j01_task_project", "SELECT t.id, p.name AS project FROM task t JOIN project p ON t.project_id = p.id")
def _(t):
    return t.task.join(t.project.select(F.col("id").alias("p"), F.col("name").alias("project")), F.col("project_id") == F.col("p")).select("id", "project")


@query("j02_tasks_of_projects", "SELECT p.id, coalesce(list_sort(list(t.id) FILTER (t.id IS NOT NULL)), []) AS tasks FROM project p LEFT JOIN task t ON t.project_id = p.id GROUP BY p.id")
def _(t):
    ids = t.task.groupBy("project_id").agg(F.sort_array(F.collect_list("id")).alias("tasks"))
    return t.project.join(ids, F.col("id") == F.col("project_id"), "left").select("id", F.coalesce("tasks", F.array().cast("array<bigint>")).alias("tasks"))


@query("j03_permitted", f"WITH {GRANTS_SQL} SELECT id FROM project WHERE id IN (SELECT object_id FROM grants WHERE user_id = 5 AND permission = 'view')")
def _(t):
    return c.allowed(t.project, grants(t), F.lit(5), "view").select("id")


@query("j04_through_owner", "SELECT t.id FROM task t JOIN project p ON t.project_id = p.id JOIN owner o ON p.owner_id = o.id WHERE o.username = 'CHINA'")
def _(t):
    mine = t.owner.where("username = 'CHINA'").select(F.col("id").alias("o"))
    p = t.project.join(mine, F.col("owner_id") == F.col("o"), "left_semi").select(F.col("id").alias("p"))
    return t.task.join(p, F.col("project_id") == F.col("p"), "left_semi").select("id")


@query("j05_through_quota", "SELECT t.id FROM task t JOIN project p ON t.project_id = p.id WHERE p.quota < 0")
def _(t):
    p = t.project.where("quota < 0").select(F.col("id").alias("p"))
    return t.task.join(p, F.col("project_id") == F.col("p"), "left_semi").select("id")


@query("j06_projects_without_failures", "SELECT id FROM project WHERE id NOT IN (SELECT project_id FROM task WHERE status = 30)")
def _(t):
    failed = t.task.where("status = 30").select("project_id")
    return t.project.join(failed, F.col("id") == F.col("project_id"), "left_anti").select("id")


@query("j07_grant_changes", f"WITH {GRANTS_SQL}, s AS (SELECT id AS object_id, (owner_id + CASE WHEN public THEN 1 ELSE 2 END) % 25 AS user_id, 'view' AS permission FROM project) SELECT coalesce(s.object_id, g.object_id) AS object_id, coalesce(s.user_id, g.user_id) AS user_id, 'view' AS permission, CASE WHEN g.object_id IS NULL THEN 'grant' WHEN s.object_id IS NULL THEN 'revoke' ELSE 'keep' END AS action FROM s FULL JOIN (SELECT * FROM grants WHERE permission = 'view') g ON s.object_id = g.object_id AND s.user_id = g.user_id")
def _(t):
    submitted = t.project.selectExpr("id AS object_id", "(owner_id + CASE WHEN public THEN 1 ELSE 2 END) % 25 AS user_id", "'view' AS permission")
    return c.grant_changes(submitted, grants(t).where("permission = 'view'"))


@query("j08_redirects", "SELECT a.id, CASE WHEN p.id IS NOT NULL THEN 'here' WHEN r.owner_id IS NOT NULL THEN 'redirect' ELSE 'missing' END AS result, CASE WHEN p.id IS NULL THEN r.owner_id END AS owner_id FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) a LEFT JOIN project p ON p.id = a.id LEFT JOIN (SELECT p_partkey AS from_id, CAST(p_size AS BIGINT) AS owner_id FROM part WHERE p_size > 20) r ON r.from_id = a.id")
def _(t):
    moved = t.part.where("p_size > 20").selectExpr("p_partkey AS from_id", "CAST(p_size AS BIGINT) AS owner_id")
    return c.redirected(t.lineitem.select(F.col("l_partkey").alias("id")).distinct(), t.project, moved)


@query("j09_orphans", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM project)")
def _(t):
    return t.lineitem.select(F.col("l_partkey").alias("id")).distinct().join(t.project.select("id"), "id", "left_anti")


@query("j10_resized_points", "SELECT p_partkey, round(p_retailprice * coalesce(r.ratio, 1), 4) AS px FROM part LEFT JOIN (SELECT DISTINCT lower(p_brand) AS brand, 0.5 AS ratio FROM part WHERE p_brand LIKE '%3') r ON lower(p_brand) = r.brand")
def _(t):
    ratios = t.part.where("p_brand LIKE '%3'").select(F.lower("p_brand").alias("brand"), F.lit(0.5).alias("ratio")).distinct()
    return t.part.join(ratios, F.lower("p_brand") == F.col("brand"), "left").select("p_partkey", rounded(F.col("p_retailprice") * F.coalesce("ratio", F.lit(1.0)), 4).alias("px"))


@query("j11_surface_minus_base", "SELECT a.y, count(*) AS n, round(sum(a.z - b.z), 4) AS total FROM dem a JOIN (SELECT x, y, z * 0.5 AS z FROM dem WHERE z IS NOT NULL) b ON a.x = b.x AND a.y = b.y GROUP BY a.y")
def _(t):
    base = t.dem.where("z IS NOT NULL").select("x", "y", (F.col("z") * 0.5).alias("base"))
    return t.dem.join(base, ["x", "y"]).groupBy("y").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("z") - F.col("base")), 4).alias("total"))


@query("j16_sync", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'insert' ELSE 'delete' END AS action FROM (SELECT DISTINCT p_size AS k FROM part) a FULL JOIN (SELECT DISTINCT CAST(c_nationkey AS INT) * 3 AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def _(t):
    return c.sync(t.part.selectExpr("p_size AS k"), t.customer.selectExpr("CAST(c_nationkey AS INT) * 3 AS k"), "k")


BOXES = ["s_suppkey AS id", "s_acctbal / 60 AS x0", "CAST(s_nationkey AS DOUBLE) * 2 AS y0", "s_acctbal / 60 + 3 AS x1", "CAST(s_nationkey AS DOUBLE) * 2 + 3 AS y1"]


@query("j17_largest_overlap", f"WITH b AS (SELECT {', '.join(BOXES)} FROM supplier), p AS (SELECT a.id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i FROM b a JOIN b ON a.id > b.id) SELECT b.id, round(coalesce(max(i / (18 - i)), 0), 6) AS overlap FROM b LEFT JOIN p USING (id) GROUP BY b.id")
def _(t):
    return c.largest_overlap(t.supplier.selectExpr(*BOXES)).select("id", rounded(F.col("overlap")).alias("overlap"))


@query("a01_used_quota", "SELECT o.id, round(coalesce(sum(t.size), 0), 2) AS used FROM owner o LEFT JOIN project p ON p.owner_id = o.id LEFT JOIN task t ON t.project_id = p.id GROUP BY o.id")
def _(t):
    by_project = t.task.groupBy("project_id").agg(F.sum("size").alias("size"))
    by_owner = t.project.join(by_project, F.col("id") == F.col("project_id")).groupBy("owner_id").agg(F.sum("size").alias("used"))
    return t.owner.join(by_owner, F.col("id") == F.col("owner_id"), "left").select("id", rounded(F.coalesce("used", F.lit(0.0)), 2).alias("used"))


@query("a02_children", "SELECT p.id, count(t.id) AS n FROM project p LEFT JOIN task t ON t.project_id = p.id AND t.status = 40 GROUP BY p.id")
def _(t):
    n = t.task.where("status = 40").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return t.project.join(n, F.col("id") == F.col("project_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("a03_by_month", "SELECT strftime(date_trunc('month', created_at), '%Y-%m') AS month, count(*) AS n FROM task WHERE year(created_at) = 1996 GROUP BY 1")
def _(t):
    return t.task.where(c.in_year("created_at", 1996)).groupBy(F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("a04_twelve_months", "SELECT m::INT AS month, count(id) AS n FROM range(1, 13) r(m) LEFT JOIN task ON year(created_at) = 2001 AND month(created_at) = m GROUP BY 1")
def _(t):
    n = t.task.where(c.in_year("created_at", 2001)).groupBy(F.month("created_at").alias("month")).agg(F.count(F.lit(1)).alias("k"))
    months = t.spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(n, "month", "left").select("month", F.coalesce("k", F.lit(0)).alias("n"))


@query("a05_names_joined", "SELECT project_id, string_agg(name, ' ' ORDER BY name) AS names FROM task WHERE name IS NOT NULL GROUP BY project_id")
def _(t):
    return t.task.where("name IS NOT NULL").groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))


@query("a06_distinct", "SELECT DISTINCT project_id, status FROM task")
def _(t):
    return t.task.select("project_id", "status").distinct()


@query("a07_exists", "SELECT count(*) > 0 AS any_failed, count(*) AS n FROM task WHERE status = 30")
def _(t):
    return t.task.where("status = 30").agg((F.count(F.lit(1)) > 0).alias("any_failed"), F.count(F.lit(1)).alias("n"))


@query("a21_sizes", "SELECT status, count(*) AS n, round(sum(size), 2) AS total FROM task GROUP BY status")
def _(t):
    return t.task.groupBy("status").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("size"), 2).alias("total"))


@query("a22_tags", "SELECT list_sort(list(DISTINCT tag)) AS tags FROM (SELECT unnest(split(tags, ' ')) AS tag FROM task) WHERE tag <> ''")
def _(t):
    tags = t.task.select("tags").distinct().select(F.explode(F.split("tags", " ")).alias("tag")).where("tag <> ''")
    return tags.agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query("a25_photo_bounds", "SELECT min(ox) AS x0, max(ox) AS x1, min(y0) AS y0, max(y0) AS y1 FROM task WHERE ox IS NOT NULL")
def _(t):
    return t.task.where("ox IS NOT NULL").agg(F.min("ox").alias("x0"), F.max("ox").alias("x1"), F.min("y0").alias("y0"), F.max("y0").alias("y1"))


@query("w02_running_size", "SELECT id, round(sum(size) OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING), 2) AS running FROM task")
def _(t):
    rows = c.running_total(t.task, "project_id", "size", [F.col("created_at").desc(), F.col("id").desc()], F.date_trunc("day", F.col("created_at").cast("timestamp")))
    return rows.select("id", rounded(F.col("running"), 2).alias("running"))


@query("w03_latest_per_owner", "SELECT owner_id, id FROM (SELECT p.owner_id, t.id, row_number() OVER (PARTITION BY p.owner_id ORDER BY t.created_at DESC, t.id DESC) AS k FROM task t JOIN project p ON t.project_id = p.id) WHERE k = 1")
def _(t):
    rows = t.task.join(t.project.select(F.col("id").alias("p"), "owner_id"), F.col("project_id") == F.col("p"))
    return rows.groupBy("owner_id").agg(F.max(F.struct("created_at", "id")).alias("m")).select("owner_id", F.col("m.id").alias("id"))


@query("w04_console_lines", "SELECT doc_id, i AS line_no, length(line) AS n FROM (SELECT doc_id, unnest(split(text, chr(10))) AS line, unnest(range(len(split(text, chr(10))))) AS i FROM documents)")
def _(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.length("line").cast("bigint").alias("n"))


@query("w05_page_numbers", "SELECT id, CAST(ceil(row_number() OVER (PARTITION BY owner_id ORDER BY name, id) / 10.0) AS BIGINT) AS page FROM project")
def _(t):
    return c.page_numbers(t.project, "name", by="owner_id").select("id", "page")


@query("o01_newest", "SELECT id FROM task ORDER BY created_at DESC, id LIMIT 10")
def _(t):
    return c.page(t.task, 1).select("id")


@query("o02_ordering", "SELECT id, status FROM task ORDER BY status DESC NULLS FIRST, name ASC NULLS LAST, id LIMIT 50")
def _(t):
    return t.task.orderBy(*c.ordering("-status,name")).limit(50).select("id", "status")


@query("o03_top_one", "SELECT id FROM node ORDER BY queue_count, id LIMIT 1")
def _(t):
    return t.node.agg(F.min(F.struct("queue_count", "id")).alias("m")).select(F.col("m.id").alias("id"))


@query("o04_absolute_limit", "SELECT id FROM owner ORDER BY id LIMIT 3")
def _(t):
    return t.owner.orderBy("id").limit(abs(-3)).select("id")


@query("o05_page_three", "SELECT id, name FROM project ORDER BY name, id LIMIT 10 OFFSET 20")
def _(t):
    return c.page(t.project, 3, order="name").select("id", "name")


_LINES = "l AS (SELECT doc_id, unnest(range(len(split(text, chr(10))))) AS line_no, len(split(text, chr(10))) AS n FROM documents)"


@query("o06_line_slice", f"WITH {_LINES} SELECT doc_id, line_no FROM l WHERE line_no >= 3 AND line_no < 8")
def _(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return c.slice_lines(rows, 3, 5, "doc_id").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"))


@query("o06_last_lines", f"WITH {_LINES} SELECT doc_id, line_no FROM l WHERE line_no >= 1 AND line_no >= n - 4")
def _(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no")
    return c.slice_lines(rows, 1, -4, "doc_id").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"))


@query("o07_capped", "SELECT id, hostname FROM node ORDER BY id LIMIT 20")
def _(t):
    return t.node.orderBy("id").limit(20).select("id", "hostname")


@query("o08_owners_first", f"WITH {GRANTS_SQL} SELECT user_id, is_owner FROM (SELECT g.user_id, bool_or(g.permission = 'delete') AS is_owner FROM grants g WHERE object_id = 12 GROUP BY 1) ORDER BY is_owner DESC, user_id")
def _(t):
    rows = grants(t).where("object_id = 12").groupBy("user_id").agg(F.bool_or(F.col("permission") == "delete").alias("is_owner"))
    return rows.orderBy(F.desc("is_owner"), "user_id")


@query("o09_first_and_last_year", "SELECT CAST(year(min(created_at)) AS INT) AS first, CAST(year(max(created_at)) AS INT) AS last FROM task")
def _(t):
    return t.task.agg(F.year(F.min("created_at")).alias("first"), F.year(F.max("created_at")).alias("last"))


@query("o10_reversed_lines", "SELECT item_id, array_to_string(list_reverse(split(text, chr(10))), chr(10)) AS text FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.array_join(F.reverse(F.split("text", "\n")), "\n").alias("text"))


@query("o11_capture_path", "SELECT task_id, string_agg(CAST(event_id AS VARCHAR), '>' ORDER BY ts, event_id) AS path FROM life GROUP BY task_id")
def _(t):
    points = F.sort_array(F.collect_list(F.struct("ts", "event_id")))
    return t.life.groupBy("task_id").agg(F.array_join(F.transform(points, lambda p: p["event_id"].cast("string")), ">").alias("path"))


@query(
    "o12_page_buttons",
    """SELECT id, list_transform(range(lo, least(pages, lo + 6) + 1), lambda x: x::INT) AS buttons FROM (
    SELECT p_partkey AS id, p_retailprice, CAST(p_size % 20 + 1 AS BIGINT) AS pages, greatest(1, least(p_partkey % (p_size % 20 + 1) + 1 - 3, p_size % 20 + 1 - 6)) AS lo FROM part)""",
)
def _(t):
    pages = F.col("p_size") % 20 + 1
    return t.part.select(F.col("p_partkey").alias("id"), c.page_buttons(F.col("p_partkey") % pages + 1, pages * 10).alias("buttons"))


@query("o13_layers", "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS k FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(t):
    rows = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("bigint"))  # a row for each type


@query("o14_least_queued", "SELECT min(id) AS id, count(*) AS tied FROM node WHERE coalesce(minutes_ago <= 5, false) AND queue_count = (SELECT min(queue_count) FROM node WHERE coalesce(minutes_ago <= 5, false))")
def _(t):
    online = t.node.where(F.coalesce(F.col("minutes_ago") <= 5, F.lit(False)))
    best = online.groupBy("queue_count").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("tied"))
    return best.agg(F.min(F.struct("queue_count", "id", "tied")).alias("m")).select(F.col("m.id").alias("id"), F.col("m.tied").alias("tied"))


OPTIONS_SQL = "o AS (SELECT l_suppkey AS id, list(DISTINCT p_size % 9) AS options FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 18 GROUP BY 1)"


@query("u01_common_options", f"WITH {OPTIONS_SQL} SELECT CAST(name AS VARCHAR) AS name FROM (SELECT id, unnest(options) AS name FROM o) GROUP BY name HAVING count(*) = (SELECT count(*) FROM o)")
def _(t):
    small = t.part.where("p_size < 18").select("p_partkey", (F.col("p_size") % 9).cast("string").alias("o"))
    nodes = t.lineitem.join(small, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("o").alias("options"))
    return c.common_options(nodes)


@query("u02_difference", "SELECT id FROM project EXCEPT SELECT project_id FROM task WHERE status = 40")
def _(t):
    return t.project.select("id").exceptAll(t.task.where("status = 40").select("project_id").distinct())


@query("u03_shareable_assets", "SELECT id, array_to_string(list_sort(list_intersect(list_transform(split(assets, ','), lambda x: trim(x)), ['orthophoto.tif', 'dsm.tif'])), ',') AS shared FROM task")
def _(t):
    shared = F.array_intersect(c.split_list(F.col("assets")), F.array(F.lit("orthophoto.tif"), F.lit("dsm.tif")))
    return t.task.select("id", F.array_join(F.sort_array(shared), ",").alias("shared"))


@query("u04_union_distinct", "SELECT id FROM owner WHERE starts_with(lower(username), 'i') UNION SELECT id FROM owner WHERE contains(email, '@1')")
def _(t):
    return t.owner.where(F.lower("username").startswith("i") | F.contains("email", F.lit("@1"))).select("id")


@query("u05_tag_difference", "SELECT id, array_to_string(list_sort(list_filter(split(tags, ' '), lambda x: x NOT IN ('all', '.hidden'))), ' ') AS own FROM project")
def _(t):
    return t.project.select("id", F.array_join(F.sort_array(F.array_except(F.split("tags", " "), F.array(F.lit("all"), F.lit(".hidden")))), " ").alias("own"))


@query("u06_subset", "SELECT id, list_has_all(split(tags, ' '), ['building', 'all']) AS fits FROM project")
def _(t):
    return t.project.select("id", (F.size(F.array_except(F.array(F.lit("building"), F.lit("all")), F.split("tags", " "))) == 0).alias("fits"))


@query("f01_search_tags", "SELECT id FROM project WHERE list_contains(regexp_extract_all(lower(tags), '[a-z0-9]+'), 'hidden') AND id IN (SELECT project_id FROM task WHERE list_contains(split(tags, ' '), 'd'))")
def _(t):
    return c.search_projects(t.project, t.task, t.owner, ":hidden ::d").select("id")


@query("f02_search_names", "SELECT p.id FROM project p LEFT JOIN (SELECT project_id, string_agg(lower(name), ' ') AS names FROM task GROUP BY 1) t ON t.project_id = p.id WHERE list_has_all(regexp_extract_all(lower(p.name) || ' ' || coalesce(names, ''), '[a-z0-9]+'), ['customer', 'urgent'])")
def _(t):
    return c.search_projects(t.project, t.task, t.owner, "URGENT  customer").select("id")


@query("f03_search_all", "SELECT p.id FROM project p JOIN owner o ON p.owner_id = o.id WHERE lower(o.username) = 'kenya' AND list_contains(split(p.tags, ' '), 'building')")
def _(t):
    return c.search_projects(t.project, t.task, t.owner, "@kenya #building ...").select("id")


@query("k09_upsert", "SELECT id, name FROM project WHERE id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return c.upsert(t.project.select("id", "name"), t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"), ["id"])


@query("k13_copies", "SELECT id + 1000000 AS id, 'Copy of ' || name AS name, false AS public, '2002-01-01' AS created FROM project UNION ALL SELECT id + 1000000, 'Copy of ' || coalesce(t.name, 'Task #' || t.id), false, '2002-01-01' FROM task t")
def _(t):
    def copy(df, name):
        return df.select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("Copy of "), name).alias("name"), F.lit(False).alias("public"), F.lit("2002-01-01").alias("created"))

    return copy(t.project, F.col("name")).unionAll(copy(t.task, F.coalesce("name", F.concat(F.lit("Task #"), F.col("id").cast("string")))))


@query("k14_soft_delete", "SELECT id, CASE WHEN project_id IN (SELECT id FROM project WHERE deleting) THEN 2 ELSE pending_action END AS pending_action FROM task")
def _(t):
    gone = t.project.where("deleting").select(F.col("id").alias("p"))
    rows = t.task.join(gone, F.col("project_id") == F.col("p"), "left")
    return rows.select("id", F.when(F.col("p").isNotNull(), F.lit(2)).otherwise(F.col("pending_action")).alias("pending_action"))


@query("k11_bounds_document", "SELECT status, '{\"bounds\":[' || CAST(CAST(min(ox) AS INT) AS VARCHAR) || ',' || CAST(CAST(min(y0) AS INT) AS VARCHAR) || ',' || CAST(CAST(max(ox) AS INT) AS VARCHAR) || ',' || CAST(CAST(max(y0) AS INT) AS VARCHAR) || '],\"minzoom\":15,\"maxzoom\":21}' AS doc FROM task WHERE ox IS NOT NULL GROUP BY status")
def _(t):
    ends = F.array(F.min("ox").cast("int"), F.min("y0").cast("int"), F.max("ox").cast("int"), F.max("y0").cast("int"))
    doc = F.to_json(F.struct(ends.alias("bounds"), F.lit(18 - 3).alias("minzoom"), F.lit(18 + 3).alias("maxzoom")))
    return t.task.where("ox IS NOT NULL").groupBy("status").agg(doc.alias("doc"))


@query("k07_backup_rows", "SELECT id, '{\"id\":' || id || ',\"name\":\"' || name || '\"}' AS doc FROM project")
def _(t):
    return t.project.select("id", F.to_json(F.struct("id", "name")).alias("doc"))


@query("s22_even_sample", "SELECT y, x FROM (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM dem) WHERE n <= 30 OR i IN (SELECT CAST(floor(k * 100 / 30.0) AS BIGINT) FROM range(30) r(k))")
def _(t):
    w = Window.partitionBy("y")
    rows = t.dem.withColumn("i", F.row_number().over(w.orderBy("x")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    picked = (F.col("n") <= 30) | (F.floor(F.ceil(F.col("i") * 30 / F.col("n")) * F.col("n") / 30) == F.col("i"))
    return rows.where(picked).select("y", "x")
