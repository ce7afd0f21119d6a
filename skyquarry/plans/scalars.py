"""Queries for scalar functions, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquarry.functions import scalars as s
from skyquarry.functions.ieee import half_away, rounded
from skyquarry.operators import formulas
from skyquarry.plans.registry import query


@query("f04_tags_to_array", "SELECT tags, list_filter(split(tags, ' '), lambda t: t <> '') AS parts, count(*) AS n FROM task GROUP BY ALL")
def _(t):
    return t.task.groupBy("tags").agg(F.count(F.lit(1)).alias("n")).select("tags", s.tags_to_array(F.col("tags")).alias("parts"), "n")


@query("f05_array_to_tags", "SELECT tags, array_to_string(list_transform(split(tags, 'e'), lambda t: trim(t)), ' ') AS joined FROM (SELECT DISTINCT tags FROM project)")
def _(t):
    return t.project.select("tags").distinct().select("tags", s.array_to_tags(F.split("tags", "e")).alias("joined"))


@query("f06_lenient_tags", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN split(p_name, ' ') ELSE [] END AS tags FROM part")
def _(t):
    good = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('","')), F.lit('"]'))
    text = F.when(F.col("p_size") % 2 == 0, good).otherwise(F.lit("not json"))
    return t.part.select("p_partkey", s.lenient_tags(text).alias("tags"))


@query("f07_download_name", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || ' / ' || p_brand || '!', '[ /]', '-', 'g'), '[^0-9a-zA-Z_-]', '', 'g') || '-' || 'all.zip', '--+', '-', 'g') AS file FROM part")
def _(t):
    return t.part.select("p_partkey", s.download_name(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!")), F.lit("all.zip")).alias("file"))


_B36 = "abcdefghijklmnopqrstuvwxyz0123456789"


@query("f10_short_ids", f"WITH RECURSIVE d AS (SELECT id, id AS n, '' AS s FROM task UNION ALL SELECT id, n // 36, substr('{_B36}', (n % 36 + 1)::INT, 1) || s FROM d WHERE n > 0 OR s = '') SELECT id, s AS short FROM d WHERE n = 0 AND s <> ''")
def _(t):
    return t.task.select("id", s.short_id(F.col("id")).alias("short"))


@query("f11_valid_short_ids", "SELECT c_custkey, regexp_full_match(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '?' END, '[A-Za-z0-9_-]+') AS ok FROM customer")
def _(t):
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("?")))
    return t.customer.select("c_custkey", s.is_short_id(name).alias("ok"))


@query("f12_valid_slugs", "SELECT p_partkey, regexp_full_match(lower(replace(p_name, ' ', '-')), '[a-z0-9][a-z0-9_-]*') AS ok, regexp_full_match(p_name, '[a-z0-9][a-z0-9_-]*') AS raw_ok FROM part")
def _(t):
    return t.part.select("p_partkey", s.is_slug(F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("ok"), s.is_slug(F.col("p_name")).alias("raw_ok"))


@query(
    "f13_durations",
    """WITH d AS (SELECT id, processing_time AS ms, processing_time // 60000 * 60 + CAST(round_even((processing_time % 60000) / 1000.0::DOUBLE, 0) AS BIGINT) AS t FROM task)
    SELECT id, CASE WHEN ms IN (0, -1) THEN '-- : -- : --' ELSE CASE WHEN t // 3600 < 10 THEN '0' ELSE '' END || t // 3600 || ':' || lpad(CAST(t // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') END AS shown FROM d""",
)
def _(t):
    return t.task.select("id", s.duration(F.col("processing_time")).alias("shown"))


@query("f14_disk_sizes", "SELECT id, printf('%.2f', round(v / 1000, 2)) AS gb, ends_with(label, unit) AS ok FROM (SELECT id, size AS v, 'GB' AS unit, 'GB' AS label FROM task)")
def _(t):
    shown = s.disk_size(F.col("size"))
    return t.task.select("id", F.format_string("%.2f", half_away(F.col("size") / 1000, 2)).alias("gb"), shown.endswith("GB").alias("ok"))


@query("f15_percentages", "SELECT id, CASE WHEN quota = 0 THEN 100 ELSE round(least(greatest(id / quota * 100, 0), 150), 6) + 0.0::DOUBLE END AS perc FROM project")
def _(t):
    return t.project.select("id", rounded(s.percentage(F.col("id"), F.col("quota"), 150)).alias("perc"))


@query("f16_grace_labels", "SELECT id, CASE WHEN q >= 172800 THEN 'in ' || CAST(floor(q / 86400) AS BIGINT) || ' days' WHEN q >= 7200 THEN 'in ' || CAST(floor(q / 3600) AS BIGINT) || ' hours' WHEN q > 1 THEN 'in ' || CAST(floor(q / 60) AS BIGINT) || ' minutes' ELSE 'very soon' END AS label FROM (SELECT id, quota * 40 AS q FROM project)")
def _(t):
    return t.project.select("id", s.grace_label(F.col("quota") * 40).alias("label"))


@query("f17_versions", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN -1 ELSE (p_size % 4) * 100000 + (p_size % 7) * 100 + p_size END AS v FROM part")
def _(t):
    size = F.col("p_size")
    text = F.when(size % 5 == 0, F.concat(F.lit("1."), F.col("p_brand"))).otherwise(F.concat_ws(".", (size % 4).cast("string"), (size % 7).cast("string"), size.cast("string"), F.lit("9")))
    return t.part.select("p_partkey", s.version_number(text).cast("int").alias("v"))


@query("f18_decimal_degrees", "SELECT event_id, round((event_id % 90 + (event_id % 60) / 60.0::DOUBLE + value / 3600.0::DOUBLE) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END, 6) + 0.0::DOUBLE AS d FROM events")
def _(t):
    i = F.col("event_id")
    return t.events.select("event_id", rounded(s.decimal_degrees(i % 90, i % 60, F.col("value"), F.when(i % 2 == 0, "S").otherwise("N"))).alias("d"))


@query("f19_dataset_urls", r"SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'https://' ELSE 'http://' END || regexp_extract(url, '://([^/]+)/', 1) AS server, regexp_extract(url, '://[^/]+/([^/?#]+)', 1) AS organization, regexp_extract(url, '://[^/]+/[^/]+/([^/?#]+)', 1) AS dataset FROM pages")
def _(t):
    return t.pages.select("page_id", *(v.alias(k) for k, v in s.dataset_url(F.col("url")).items()))


@query("f20_category_paths", "WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 8 THEN NULL ELSE p_partkey // 8 END AS parent, p_brand AS name, p_size AS images FROM part), w AS (SELECT id, name AS path, images FROM n WHERE parent IS NULL UNION ALL SELECT n.id, w.path || ' > ' || n.name, n.images FROM n JOIN w ON n.parent = w.id) SELECT id, path FROM w WHERE images > 10")
def _(t):
    t.part.selectExpr("p_partkey AS id", "CASE WHEN p_partkey < 8 THEN NULL ELSE p_partkey div 8 END AS parent", "p_brand AS name", "p_size AS images").createOrReplaceTempView("sq_categories")
    return t.spark.sql(
        """WITH RECURSIVE w(id, path, images) AS (SELECT id, name, images FROM sq_categories WHERE parent IS NULL
           UNION ALL SELECT n.id, w.path || ' > ' || n.name, n.images FROM sq_categories n JOIN w ON n.parent = w.id)
           SELECT id, path FROM (SELECT * FROM w LIMIT ALL) WHERE images > 10"""  # LIMIT ALL lifts Spark's bound on a recursion's rows
    )


def _options():
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.col(v).cast("string").alias("value"))
    return F.array(pair("size", "p_size"), pair("brand", "p_brand"), pair("size", "p_type"))


@query("f21_options_map", "SELECT p_partkey, p_type AS size, p_brand AS brand FROM part")
def _(t):
    m = s.options_map(_options())
    return t.part.select("p_partkey", m["size"].alias("size"), m["brand"].alias("brand"))


@query("f22_option_removed", "SELECT p_partkey, 2 AS n FROM part")
def _(t):
    return t.part.select("p_partkey", F.size(s.without_option(_options(), "brand")).alias("n"))


@query("f23_option_lookup", "SELECT p_partkey, p_brand AS brand, CAST(NULL AS VARCHAR) AS missing FROM part")
def _(t):
    return t.part.select("p_partkey", s.option_value(_options(), "brand").alias("brand"), s.option_value(_options(), "rerun-from").alias("missing"))


_LINE = "concat_ws(' ', CAST(p_size AS STRING), CAST(p_size * 2 AS STRING), CASE WHEN p_size % 6 = 0 THEN 'up' ELSE '3' END, '4', '5', CASE WHEN p_size % 7 <> 0 THEN p_brand END, CASE WHEN p_size % 4 = 0 THEN 'extra one' END)"


@query("f24_control_points", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_size * 2 AS DOUBLE) AS y, 2.0::DOUBLE AS half_px, p_brand AS filename, CASE WHEN p_size % 4 = 0 THEN 'extra one' ELSE '' END AS extras FROM part WHERE p_size % 6 <> 0 AND p_size % 7 <> 0 UNION ALL SELECT p_partkey, p_size, p_size * 2, 2, 'extra', 'one' FROM part WHERE p_size % 7 = 0 AND p_size % 4 = 0 AND p_size % 6 <> 0")
def _(t):
    rows = t.part.select("p_partkey", s.ground_control(F.expr(_LINE)).alias("g")).where("g IS NOT NULL")
    return rows.select("p_partkey", "g.x", "g.y", (F.col("g.px") * 0.5).alias("half_px"), "g.filename", "g.extras")


@query("f25_control_point_problems", "SELECT CASE WHEN p_size % 7 = 0 AND p_size % 4 <> 0 THEN 'too few entries' WHEN p_size % 6 = 0 THEN 'z is not a number' END AS problem, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy(s.ground_control_problem(F.expr(_LINE)).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("f26_namespaced_keys", "SELECT 'shop::' || p_brand AS key, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy(s.namespaced("shop", F.col("p_brand")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("f27_map_layers", "SELECT id, array_to_string(list_concat(list_concat(CASE WHEN contains(assets, 'orthophoto') THEN ['orthophoto', 'plant'] ELSE [] END, CASE WHEN contains(assets, 'dsm') THEN ['dsm'] ELSE [] END), CASE WHEN contains(assets, 'dtm') THEN ['dtm'] ELSE [] END), ',') AS layers FROM task")
def _(t):
    from skyquarry.operators.catalog import split_list

    return t.task.select("id", F.array_join(s.map_layers(split_list(F.col("assets"))), ",").alias("layers"))


@query("f28_permission_names", "SELECT id, 'view' AS name FROM project UNION ALL SELECT id, 'delete' FROM project")
def _(t):
    names = F.explode(F.array(F.lit("view_project"), F.lit("delete_project")))
    return t.project.select("id", names.alias("full")).select("id", F.replace("full", F.lit("_project"), F.lit("")).alias("name"))


@query("f29_mapped_files", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'gcp_list.txt' ELSE p_brand || '.jpg' END AS file FROM part")
def _(t):
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit("_gcp_list (2).txt"))).otherwise(F.concat("p_brand", F.lit(".jpg")))
    return t.part.select("p_partkey", s.mapped_file(name).alias("file"))


@query("f31_merged_json", "SELECT p_partkey, p_brand AS a, p_type AS b, CAST(NULL AS VARCHAR) AS view FROM part")
def _(t):
    old = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_type"), F.lit("view"), F.col("p_name"))
    new = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("settings"), F.col("p_name"))
    m = s.merged_json(old, new)
    return t.part.select("p_partkey", F.try_element_at(m, F.lit("a")).alias("a"), F.try_element_at(m, F.lit("b")).alias("b"), F.try_element_at(m, F.lit("view")).alias("view"))


@query("f32_preset_options", "SELECT o.name, o.standard, coalesce(p.value, o.standard) AS value FROM (SELECT p_type AS name, min(p_size) AS standard FROM part GROUP BY 1) o LEFT JOIN (SELECT p_type AS name, max(p_size) AS value FROM part WHERE p_brand LIKE '%1' GROUP BY 1) p USING (name)")
def _(t):
    own = t.part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_size").alias("standard"))
    preset = t.part.where("p_brand LIKE '%1'").groupBy(F.col("p_type").alias("name")).agg(F.max("p_size").alias("own"))
    return own.join(preset, "name", "left").select("name", "standard", F.coalesce("own", "standard").alias("value")).orderBy("name")


@query("f33_byte_labels", "SELECT id, CASE WHEN b < 1000 THEN b || ' bytes' WHEN b < 1000000 THEN trim(trim(printf('%.2f', round(b / 1000.0::DOUBLE, 2)), '0'), '.') || ' KB' WHEN b < 1000000000 THEN rtrim(rtrim(printf('%.2f', round(b / 1e6::DOUBLE, 2)), '0'), '.') || ' MB' ELSE rtrim(rtrim(printf('%.2f', round(b / 1e9::DOUBLE, 2)), '0'), '.') || ' GB' END AS label FROM (SELECT id, CAST(floor(size * 12345.6789::DOUBLE) AS BIGINT) AS b FROM task)")
def _(t):
    return t.task.select("id", s.bytes_label(F.floor(F.col("size") * 12345.6789)).alias("label"))


@query("f34_default_index", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'NDVI' WHEN 1 THEN 'VARI' ELSE 'Celsius' END AS v FROM part")
def _(t):
    text = F.expr("CASE p_size % 3 WHEN 0 THEN 'Red,green,blue,NIR' WHEN 1 THEN 'Red,Green,Blue' ELSE 'lwir,alpha' END")
    return t.part.select("p_partkey", formulas.default_index_of(F.split(text, ",")).alias("v"))


@query("f36_input_names", r"SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' #1', '\s+', '', 'g'), '[^0-9a-zA-Z_-]', '', 'g') || '.json' AS file FROM part")
def _(t):
    return t.part.select("p_partkey", s.input_name(F.concat("p_name", F.lit(" #1")), ".json").alias("file"))


@query("m18_tile_urls", "SELECT id, '/api/tasks/' || id || '/dsm/tiles.json?rescale=0%2C100' || CASE WHEN public THEN '&color_map=viridis' ELSE '' END AS url FROM task")
def _(t):
    params = {"color_map": F.when(F.col("public"), F.lit("viridis")), "rescale": F.lit("0,100")}
    return t.task.select("id", s.tile_url(F.col("id").cast("string"), F.lit("dsm"), params).alias("url"))


@query("m19_reductions", "SELECT id, CASE WHEN size <= 500 THEN 0 ELSE CAST(ceil(ln(size / 500) / ln(2.6::DOUBLE) - 1e-9) AS INT) END AS n FROM task")
def _(t):
    return t.task.select("id", s.reductions(F.col("size"), 500.0).alias("n"))


@query("m20_month_and_year", "SELECT CAST(year(created_at) AS INT) AS y, strftime(date_trunc('month', created_at), '%Y-%m-%d') AS m, count(*) AS n FROM task GROUP BY ALL")
def _(t):
    month = F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM-dd")
    return t.task.groupBy(F.year("created_at").alias("y"), month.alias("m")).agg(F.count(F.lit(1)).alias("n"))


@query("m21_deadlines", "SELECT id, CAST(epoch(created_at) AS BIGINT) + 72 * 3600 AS deadline FROM task")
def _(t):
    return t.task.select("id", (F.unix_timestamp("created_at") + 72 * 3600).alias("deadline"))


@query("m22_progress", "SELECT event_id, round(value / 500 * 0.85 + CASE WHEN event_type = 'purchase' THEN 0.1 ELSE 0 END, 6) AS progress FROM events")
def _(t):
    return t.events.select("event_id", rounded(s.progress(F.col("value") / 5, (F.col("event_type") == "purchase").cast("int"))).alias("progress"))


@query("m23_staggered", "SELECT owner_id, CAST(ceil((max(id) + 1000) / 1000.0) * 1000 + 2 AS BIGINT) AS next FROM project GROUP BY 1")
def _(t):
    return t.project.groupBy("owner_id").agg(s.staggered(F.max("id"), 1000, 3).alias("next"))


@query("m24_resize_ratios", "SELECT p_partkey, round(CASE WHEN greatest(p_size * 100, p_retailprice) < 2048 THEN 1 ELSE 2048.0::DOUBLE / greatest(p_size * 100, p_retailprice) END, 6) AS ratio FROM part")
def _(t):
    return t.part.select("p_partkey", rounded(s.resize_ratio((F.col("p_size") * 100).cast("double"), F.col("p_retailprice"), 2048)).alias("ratio"))


@query("m25_resized_sides", "SELECT p_partkey, CAST(greatest(ceil(p_size * 0.3::DOUBLE), 1) AS BIGINT) AS side FROM part")
def _(t):
    return t.part.select("p_partkey", s.resized(F.col("p_size"), F.lit(0.3)).alias("side"))


@query("m26_control_errors", "SELECT c_custkey, round(abs(greatest(c_acctbal / 1000, c_nationkey - 10.0::DOUBLE)), 3) AS horizontal, round(abs(c_acctbal / 700), 3) AS vertical FROM customer")
def _(t):
    h, v = s.control_errors(F.col("c_acctbal") / 1000, F.col("c_nationkey") - F.lit(10.0), F.col("c_acctbal") / 700)
    return t.customer.select("c_custkey", h.alias("horizontal"), v.alias("vertical"))
