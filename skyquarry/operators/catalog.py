"""Catalog queries: search, filters, permissions, ordering, paging and counts over projects, tasks and nodes."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Search:
    """A parsed search text: ``##tag`` of tasks, ``#tag`` of projects, ``@user``, other words for names; ``:`` may stand for ``#``."""

    names: list[str] = field(default_factory=list)
    project_tags: list[str] = field(default_factory=list)
    task_tags: list[str] = field(default_factory=list)
    user: str | None = None


def terms(text: str) -> list[str]:
    """Lower-case words of letters and digits."""
    return re.findall(r"[^\W_]+", text.lower())


def parse_search(text: str) -> Search:
    """Only the first user counts; a term without letters or digits is dropped."""
    out = Search()
    for word in text.replace(":", "#").split():
        if word.startswith("##"):
            out.task_tags += terms(word)
        elif word.startswith("#"):
            out.project_tags += terms(word)
        elif word.startswith("@"):
            out.user = out.user or word[1:]
        else:
            out.names += terms(word)
    return out


def words(text: Column) -> Column:
    """Lower-case words of a text column."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def has_all(found: Column, wanted: list[str]) -> Column:
    return reduce(lambda a, w: a & F.array_contains(found, w), wanted, F.lit(True))


def search_projects(projects: DataFrame, tasks: DataFrame, owners: DataFrame, text: str) -> DataFrame:
    """Projects that match a search: name words in the project's or its tasks' names together, tags, owner.

    Task names and tags are gathered by project before the join, only if the search needs them.
    """
    s = parse_search(text)
    out = projects
    if s.user is not None:
        mine = owners.where(F.lower("username") == s.user.lower()).select(F.col("id").alias("_owner"))
        out = out.join(mine, F.col("owner_id") == F.col("_owner"), "left_semi")
    if s.project_tags:
        out = out.where(has_all(words(F.col("tags")), s.project_tags))
    if s.names:
        found = tasks.groupBy(F.col("project_id").alias("_p")).agg(F.flatten(F.collect_set(words(F.col("name")))).alias("_words"))
        both = F.concat(words(F.col("name")), F.coalesce("_words", F.array().cast("array<string>")))
        out = out.join(found, F.col("id") == F.col("_p"), "left").where(has_all(both, s.names)).drop("_p", "_words")
    if s.task_tags:
        tagged = tasks.where(has_all(words(F.col("tags")), s.task_tags)).select(F.col("project_id").alias("_p"))
        out = out.join(tagged, F.col("id") == F.col("_p"), "left_semi")
    return out


def split_list(text: Column) -> Column:
    """Trimmed entries of a comma list, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def with_assets(tasks: DataFrame, wanted: str) -> DataFrame:
    """Tasks that have every asset of a comma list."""
    names = [x.strip() for x in wanted.split(",") if x.strip()]
    return tasks.where(F.size(F.array_except(F.array(*(F.lit(x) for x in names)).cast("array<string>"), split_list(F.col("assets")))) == 0)


def parse_box(text: str) -> tuple[float, float, float, float]:
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box is four numbers")
    return tuple(parts)


def overlaps(box: tuple[float, float, float, float], x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Do the boxes touch? Null extents never do."""
    return F.coalesce((x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1]), F.lit(False))


def matching(df: DataFrame, exact: Mapping[str, object]) -> DataFrame:
    """Equality filters from a dict; None means null."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isNull() if kv[1] is None else F.col(kv[0]) == kv[1]), exact.items(), df)


def starts_with_either(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, c: a | F.lower(F.col(c)).startswith(prefix.lower()), columns, F.lit(False)))


def in_year(column: str, year: int) -> Column:
    """A half-open range, so that scans can skip by it."""
    return (F.col(column) >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col(column) < F.lit(f"{year + 1}-01-01").cast("timestamp"))


def ordering(text: str) -> list[Column]:
    """``a,-b``: nulls last when rising, first when falling; ``id`` breaks ties."""
    keys = [k.strip() for k in text.split(",") if k.strip()]
    out = [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]
    return [*out, F.col("id").asc()] if "id" not in [k.lstrip("-") for k in keys] else out


def page(df: DataFrame, number: int, size: int = 10, order: str = "-created_at") -> DataFrame:
    return df.orderBy(*ordering(order)).offset((number - 1) * size).limit(size)


def page_numbers(df: DataFrame, order: str, size: int = 10, by: str | None = None) -> DataFrame:
    """Each row's page within its group."""
    spec = Window.partitionBy(*([by] if by else [])).orderBy(*ordering(order))
    return df.withColumn("page", F.ceil(F.row_number().over(spec) / size))


def allowed(df: DataFrame, grants: DataFrame, user: Column | str, permission: str) -> DataFrame:
    """Rows on which the user holds the permission."""
    mine = grants.where((F.col("user_id") == user) & (F.col("permission") == permission)).select(F.col("object_id").alias("_o"))
    return df.join(mine, F.col("id") == F.col("_o"), "left_semi")


def grant_changes(submitted: DataFrame, stored: DataFrame) -> DataFrame:
    """(object_id, user_id, permission, action): grant what is only submitted, revoke what is only stored, keep the rest."""
    keys = ["object_id", "user_id", "permission"]
    a, b = submitted.select(*keys).distinct().withColumn("_new", F.lit(True)), stored.select(*keys).distinct().withColumn("_old", F.lit(True))
    action = F.when(F.col("_old").isNull(), "grant").when(F.col("_new").isNull(), "revoke").otherwise("keep")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"))


def sync(present: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, action): insert what is only present, delete what is only in the table."""
    a, b = present.select(key).distinct().withColumn("_a", F.lit(1)), table.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull()).select(key, F.when(F.col("_b").isNull(), "insert").otherwise("delete").alias("action"))


def redirected(asked: DataFrame, known: DataFrame, redirects: DataFrame) -> DataFrame:
    """asked(id) with where it leads: itself if known, else what the redirects say, else null."""
    here, there = known.select(F.col("id").alias("_k")), redirects.select(F.col("from_id").alias("_f"), "owner_id")
    out = asked.join(here, F.col("id") == F.col("_k"), "left").join(there, F.col("id") == F.col("_f"), "left")
    return out.select("id", F.when(F.col("_k").isNotNull(), "here").when(F.col("owner_id").isNotNull(), "redirect").otherwise("missing").alias("result"), F.when(F.col("_k").isNull(), F.col("owner_id")).alias("owner_id"))


def common_options(nodes: DataFrame) -> DataFrame:
    """nodes(id, options) to the option names that all of them have, with the value of the first node.

    A node without options empties the result, unless no node before it had any.
    """
    filled = nodes.where(F.size("options") > 0)
    first = filled.agg(F.min("id").alias("_first"))  # one row
    counted = nodes.crossJoin(F.broadcast(first)).where((F.size("options") > 0) | (F.col("id") > F.col("_first")))
    total = counted.agg(F.count(F.lit(1)).alias("_n"))  # one row
    rows = filled.select("id", F.explode(F.array_distinct("options")).alias("name"))
    found = rows.groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    return found.crossJoin(F.broadcast(total)).where("k = _n").select("name")


def running_total(df: DataFrame, by: str, value: str, order: list[Column], step: Column | None = None) -> DataFrame:
    """df with running: the sum of a group's values in an order, up to each row.

    step: a coarser expression of the order's first column (a day of its time), which
    must be descending.  Then only a group's steps meet in one window, as sums, and a
    row only those of its step; null steps come last.
    """
    upto = lambda spec: F.sum(value).over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if step is None:
        return df.withColumn("running", upto(Window.partitionBy(by).orderBy(*order)))
    rows = df.withColumn("_step", step)
    return _within(rows, _before(rows, by, value), by, value, order).drop("_step", "_before")


def _before(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, _at, _before): what comes before each step of a group."""
    steps = rows.groupBy(by, "_step").agg(F.sum(value).alias("_sum"))
    spec = Window.partitionBy(by).orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return steps.select(F.col(by).alias("_by"), F.col("_step").alias("_at"), F.coalesce(F.sum("_sum").over(spec), F.lit(0.0)).alias("_before"))


def _within(rows: DataFrame, before: DataFrame, by: str, value: str, order: list[Column]) -> DataFrame:
    met = rows.join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_step").eqNullSafe(F.col("_at"))).drop("_by", "_at")
    spec = Window.partitionBy(by, "_step").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.withColumn("running", F.col("_before") + F.sum(value).over(spec))


def over_quota_tasks(tasks: DataFrame, quotas: DataFrame) -> DataFrame:
    """The newest tasks of owners beyond their quota, as many as must go to meet it; negative quotas are unlimited.

    tasks(id, owner_id, created_at, size), quotas(owner_id, quota).  An owner's days
    are summed first; only tasks of days that are reached before the excess is met
    are ranked, each within its day.
    """
    limited = quotas.where("quota >= 0")
    used = tasks.groupBy("owner_id").agg(F.sum("size").alias("used"))
    over = used.join(limited, "owner_id").where("used > quota").select("owner_id", (F.col("used") - F.col("quota")).alias("excess"))
    rows = tasks.join(over, "owner_id").withColumn("_step", F.date_trunc("day", F.col("created_at").cast("timestamp")))
    reached = _before(rows, "owner_id", "size").join(over.withColumnsRenamed({"owner_id": "_by", "excess": "_excess"}), "_by").where("_before < _excess").drop("_excess")
    rows = _within(rows, reached, "owner_id", "size", [F.col("created_at").desc(), F.col("id").desc()])
    return rows.where(F.col("running") - F.col("size") < F.col("excess")).select("id", "owner_id", "size", "excess")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 where the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - w * h
    return F.when(union <= 0, F.lit(0.0)).otherwise(F.try_divide(w * h, union))


def largest_overlap(boxes: DataFrame, cell: float = 4.0) -> DataFrame:
    """(id, overlap): each box's largest intersection over union with a box of smaller id.

    Boxes meet in grid cells: only boxes that share one can overlap, so the theta
    join becomes an equi-join on cells, counted in the first cell they share.
    boxes(id, x0, y0, x1, y1), extents of bounded size.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    other = cells.select(*(F.col(c).alias(f"o_{c}") for c in cells.columns))
    pairs = cells.join(other, (F.col("cx") == F.col("o_cx")) & (F.col("cy") == F.col("o_cy")) & (F.col("id") > F.col("o_id")))
    pairs = pairs.where((F.col("cx") == F.greatest(at("x0"), at("o_x0"))) & (F.col("cy") == F.greatest(at("y0"), at("o_y0"))))
    names = ("x0", "y0", "x1", "y1")
    best = pairs.groupBy("id").agg(F.max(iou([F.col(c) for c in names], [F.col(f"o_{c}") for c in names])).alias("best"))
    return boxes.select("id").join(best, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("overlap"))


def slice_lines(lines: DataFrame, start: int, limit: int, by: str, line_no: str = "line_no") -> DataFrame:
    """Lines from ``start`` on: ``limit`` of them, all if 0, the last -limit if negative."""
    out = lines.where(F.col(line_no) >= start)
    if limit > 0:
        return out.where(F.col(line_no) < start + limit)
    if limit < 0:
        count = F.max(line_no).over(Window.partitionBy(by)) + 1
        return out.withColumn("_n", count).where(F.col(line_no) >= F.col("_n") + limit).drop("_n")
    return out


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows replaced or added by key."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


def paginator(current: int, total: int, size: int = 10, width: int = 7) -> list[int]:
    """Page buttons: up to ``width`` pages around the current one."""
    pages = max(1, -(-total // size))
    first = max(1, min(current - width // 2, pages - width + 1))
    return list(range(first, min(pages, first + width - 1) + 1))


def page_buttons(page: Column, total: Column, size: int = 10, window: int = 7) -> Column:
    """The page numbers to offer around a page: ``window`` of them, fewer only if there are no more."""
    pages = F.greatest(F.ceil(total / size), F.lit(1)).cast("int")
    first = F.greatest(F.lit(1), F.least(page.cast("int") - window // 2, pages - (window - 1)))
    return F.sequence(first, F.least(pages, first + (window - 1)))
