"""Queries of archives, leases, schedules, shipped functions and extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquarry.functions import scalars as s
from skyquarry.functions.ieee import rounded
from skyquarry.operators import jobs
from skyquarry.plans.registry import query
from skyquarry.sources import archives

_FILES = "SELECT o_custkey AS archive, CASE o_orderkey % 3 WHEN 0 THEN '../' WHEN 1 THEN 'img/' ELSE './' END || o_orderkey || '.txt' AS member, o_orderpriority AS content FROM orders"


def _archives(t):
    name = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '../' WHEN 1 THEN 'img/' ELSE './' END || o_orderkey || '.txt'")
    files = t.orders.select(F.col("o_custkey").cast("string").alias("archive"), name.alias("member"), F.col("o_orderpriority").cast("binary").alias("content"))
    return archives.archived(files)


@query("k06_backup_archives", f"SELECT CAST(archive AS VARCHAR) AS archive, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS size, string_agg(content, '' ORDER BY member) AS text FROM ({_FILES}) GROUP BY 1")
def _(t):
    back = archives.members(_archives(t))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("member", F.col("content").cast("string").alias("c")))), lambda x: x["c"]), "")
    return back.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), text.alias("text"))


@query("s14_imported_archives", f"SELECT CAST(archive AS VARCHAR) AS archive, member, CASE WHEN starts_with(member, '../') THEN 'leaves its folder' END AS refused FROM ({_FILES})")
def _(t):
    return archives.imported(_archives(t)).select("archive", "member", "refused")


@query(
    "f30_path_check",
    """SELECT p_partkey, path, NOT contains(path, 'x/../../') AND NOT starts_with(path, '/media2') AS inside FROM (
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '/media/' || p_brand WHEN 1 THEN '/media/./a/../' || p_brand WHEN 2 THEN '/media/x/../../' || p_brand ELSE '/media2/' || p_brand END AS path FROM part)""",
)
def _(t):
    path = F.expr("CASE p_size % 4 WHEN 0 THEN '/media/' || p_brand WHEN 1 THEN '/media/./a/../' || p_brand WHEN 2 THEN '/media/x/../../' || p_brand ELSE '/media2/' || p_brand END")
    return t.part.select("p_partkey", path.alias("path"), archives.stays_inside(path, F.lit("/media")).alias("inside"))


@query(
    "r15_image_thumbnails",
    """SELECT id, least(greatest(w, h), 512) AS size, round(w / 2.0::DOUBLE - w / k / 2.0::DOUBLE, 6) AS off_x, round(h / 2.0::DOUBLE - h / k / 2.0::DOUBLE, 6) AS off_y,
      round((0.25::DOUBLE + 0.5 - cx) * w * k - (w / 2.0::DOUBLE - w / k / 2.0::DOUBLE) * k, 6) AS px, round((0.75::DOUBLE + 0.5 - cy) * h * k - (h / 2.0::DOUBLE - h / k / 2.0::DOUBLE) * k, 6) AS py,
      round(3 * greatest(w, h) / 100.0::DOUBLE, 6) AS radius FROM (
    SELECT p_partkey AS id, CAST(p_size * 40 + 100 AS BIGINT) AS w, CAST(p_size * 30 + 90 AS BIGINT) AS h, (p_partkey % 5) / 4::DOUBLE AS cx, (p_partkey % 3) / 2::DOUBLE AS cy, power(2.0::DOUBLE, p_partkey % 4) AS k FROM part)""",
)
def _(t):
    rows = t.part.selectExpr("p_partkey AS id", "CAST(p_size * 40 + 100 AS BIGINT) AS w", "CAST(p_size * 30 + 90 AS BIGINT) AS h", "(p_partkey % 5) / 4D AS cx", "(p_partkey % 3) / 2D AS cy", "CAST(p_partkey % 4 + 1 AS DOUBLE) AS zoom")
    view = s.image_thumbnail(F.col("w"), F.col("h"), F.col("cx"), F.col("cy"), F.col("zoom"), F.lit(512))
    x, y, r = s.drawn_point(F.lit(0.25), F.lit(0.75), F.lit(3.0), F.col("w"), F.col("h"), F.col("cx"), F.col("cy"), F.col("zoom"))
    return rows.select("id", view["size"].alias("size"), rounded(view["off_x"]).alias("off_x"), rounded(view["off_y"]).alias("off_y"), rounded(x).alias("px"), rounded(y).alias("py"), rounded(r).alias("radius"))


_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query("t09_lease_periods", """WITH g AS (SELECT task_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS new FROM life WINDOW w AS (PARTITION BY task_id ORDER BY ts)),
    r AS (SELECT task_id, ts, sum(new) OVER (PARTITION BY task_id ORDER BY ts) AS run FROM g)
    SELECT task_id, epoch_us(min(ts)) AS taken, epoch_us(max(ts)) + 21600000000 AS until, count(*) AS beats FROM r GROUP BY task_id, run""")
def _(t):
    held = jobs.lease_periods(t.life, stale=6 * 3600.0)
    return held.select("task_id", F.unix_micros(F.col("taken").cast("timestamp")).alias("taken"), F.unix_micros("until").alias("until"), "beats")


@query("t09_leases_now", f"SELECT task_id, epoch_us({_NOW}) - epoch_us(max(ts)) <= 86400000000 AS held FROM life GROUP BY 1")
def _(t):
    last = t.life.groupBy("task_id").agg(F.max("ts").alias("at"))
    return last.select("task_id", jobs.leased(F.col("at"), F.expr(_NOW), 86400.0).alias("held"))


_JOBS = "['" + "','".join(jobs.SCHEDULES) + "']"


@query("t10_dropped_jobs", f"SELECT job, count(*) AS n, count(*) FILTER (epoch_us(ts) - floor(epoch_us(ts) / 1000000 / every) * every * 1000000 > CAST(win AS BIGINT) * 1000000) AS dropped FROM (SELECT ts, {_JOBS}[event_id % {len(jobs.SCHEDULES)} + 1] AS job FROM events) JOIN (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in jobs.SCHEDULES.items()) + ") v(name, every, win) ON name = job GROUP BY 1")
def _(t):
    names = F.array(*(F.lit(k) for k in jobs.SCHEDULES))
    rows = t.events.select("ts", F.element_at(names, (F.col("event_id") % len(jobs.SCHEDULES) + 1).cast("int")).alias("job"))
    due, window = jobs.due_runs(F.col("job"), F.col("ts"))
    return rows.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.count_if(jobs.expired(due, F.col("ts"), window)).alias("dropped"))


_DOUBLE = '''
def double(argument, progress):
    progress("halfway", 50)
    if argument.endswith("7"):
        raise ValueError(argument)
    progress("done", 100)
    return argument.encode() if argument.endswith("8") else str(2 * int(argument))
'''


@query(
    "e01_shipped_function",
    """SELECT k AS job, CASE WHEN k % 5 = 0 OR k % 10 IN (7, 8) THEN NULL ELSE CAST(2 * k AS VARCHAR) END AS output,
    CASE WHEN k % 5 = 0 THEN 'error' WHEN k % 10 = 7 THEN 'error' WHEN k % 10 = 8 THEN 'file' ELSE 'output' END AS kind,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 10 = 7 THEN 50::DOUBLE ELSE 100::DOUBLE END AS progress FROM (SELECT c_custkey AS k FROM customer)""",
)
def _(t):
    calls = t.customer.select(F.col("c_custkey").alias("job"), F.when(F.col("c_custkey") % 5 == 0, F.lit("missing")).otherwise(F.lit("double")).alias("function"), F.col("c_custkey").cast("string").alias("argument"))
    done = jobs.run_shipped(calls, {"double": (_DOUBLE, "double")})
    _, kind = jobs.result_state(F.col("output"), F.col("file"), F.col("error"), F.lit(True))
    return done.select("job", "output", kind.alias("kind"), "progress")


@query(
    "e03_result_states",
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'file' WHEN 'signup' THEN 'output' ELSE CASE WHEN value > 50 THEN 'pending' ELSE 'unknown' END END AS kind, event_type IN ('error', 'purchase', 'signup') AS ready FROM events",
)
def _(t):
    is_ = lambda x: F.when(F.col("event_type") == x, F.lit(x))
    ready, kind = jobs.result_state(is_("signup"), is_("purchase"), is_("error"), F.col("value") > 50)
    return t.events.select("event_id", kind.alias("kind"), ready.alias("ready"))


class _Cost(jobs.Extension):
    name = "cost"

    def columns(self):
        return {"total": lambda price, discount: price * (F.lit(1.0) - discount)}

    def on_signal(self, signals):
        return signals.where("kind = 'error'").groupBy("task_id").agg(F.count(F.lit(1)).alias("failures"))


@query("e04_extension_columns", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1.0::DOUBLE - l_discount), 4) AS total FROM lineitem")
def _(t):
    registry = jobs.Registry()
    registry.add(_Cost())
    return t.lineitem.select("l_orderkey", "l_linenumber", rounded(registry.column("cost/total", F.col("l_extendedprice"), F.col("l_discount")), 4).alias("total"))


@query("e04_extension_signals", "SELECT task_id, count(*) AS failures FROM life WHERE kind = 'error' GROUP BY 1")
def _(t):
    registry = jobs.Registry()
    registry.add(_Cost())
    return registry.signal(t.life)["cost"]


class _Bucket(jobs.Platform):
    """A folder of files with a listing."""

    def recognises(self, url):
        return F.startswith(url, F.lit("store://"))

    def listing_url(self, url):
        return F.concat(url, F.lit("/listing.json"))

    def image_urls(self, listing):
        return listing.where(F.lower("file").rlike(r"\.(jpe?g|tiff?)$")).select("url", F.concat_ws("/", "url", "file").alias("image"))

    def folder_name(self, url):
        return F.element_at(F.split(url, "/"), -1)

    def form_fields(self):
        return ["url"]


@query("e08_platform", "SELECT 'store://' || p_brand || '/listing.json' AS listing, p_brand AS folder, count(*) AS images FROM part WHERE p_size % 3 <> 0 GROUP BY p_brand")
def _(t):
    own = _Bucket()
    ending = F.expr("CASE p_size % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.JPG' ELSE '.tif' END")
    files = t.part.select(F.concat(F.lit("store://"), "p_brand").alias("url"), F.concat(F.col("p_partkey").cast("string"), ending).alias("file")).where(own.recognises(F.col("url")))
    return own.image_urls(files).groupBy(own.listing_url(F.col("url")).alias("listing"), own.folder_name(F.col("url")).alias("folder")).agg(F.count(F.lit(1)).alias("images"))
