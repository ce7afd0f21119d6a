from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyquarry.operators import catalog as c
from skyquarry.operators import lifecycle as li


@pytest.fixture(scope="module")
def world(spark):
    users = spark.createDataFrame([(1, "bossquarry", "boss@quarry.example"), (2, "surveyor", "first@bench.example"), (3, "surveyor2", "second@bench.example")], "id long, username string, email string")
    projects = spark.createDataFrame(
        [(1, 2, "north pit", "bank clay .quiet"), (2, 2, "north pit2", "clay dust"), (3, 2, "East Ramp", ""), (4, 1, "Old Tailings", "")], "id long, owner_id long, name string, tags string"
    )
    tasks = spark.createDataFrame([(10, 1, "Flight0", ""), (11, 1, "Flight1", "dust edge .quiet"), (12, 2, "Flight2", "edges .quiet")], "id long, project_id long, name string, tags string")
    return projects, tasks, users


@pytest.mark.parametrize(
    ("text", "ids"),
    [(":clay", [1, 2]), (":dust", [2]), ("pit2", [2]), ("::edge", [1]), ("::quiet", [1, 2]), ("Flight2", [2]), ("@sUrVeYoR", [1, 2, 3]), ("@sUrVeYoR Flight2", [2]), ("@Flight2", []), ("...", [1, 2, 3, 4])],
)
def test_search(world, text, ids):
    assert sorted(r.id for r in c.search_projects(*world, text).collect()) == ids


def test_user_prefix(world):
    assert [r.id for r in c.starts_with_either(world[2], "boss", "username", "email").collect()] == [1]


def test_task_listing(spark):
    rows = [(1, 40, "dsm.tif,georeferenced_model.laz", None, None, None, None, -11.4325, 48.4578, -11.4310, 48.4593), (2, 30, "orthophoto.tif,georeferenced_model.laz", -11.4325, 48.4578, -11.4310, 48.4593, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, status int, assets string, ox0 double, oy0 double, ox1 double, oy1 double, dx0 double, dy0 double, dx1 double, dy1 double")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(c.matching(df, {"status": 40})) == [1]
    assert ids(c.with_assets(df, "georeferenced_model.laz,dsm.tif")) == [1] and ids(c.with_assets(df, "orthophoto.tif")) == [2] and ids(c.with_assets(df, " ,")) == [1, 2]

    def inside(text):
        box = c.parse_box(text)
        return ids(df.where(c.overlaps(box, *(F.col(f"o{k}") for k in ("x0", "y0", "x1", "y1"))) | c.overlaps(box, *(F.col(f"d{k}") for k in ("x0", "y0", "x1", "y1")))))

    assert inside("-11.4320,48.4588,-11.4310,48.4593") == [1, 2] and inside("-11.4420,48.4688,-11.4410,48.4693") == []
    with pytest.raises(ValueError):
        c.parse_box("bad")


def test_common_options(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, options array<string>")
    names = lambda df: sorted(r.name for r in c.common_options(df).collect())
    assert names(make((1, ["a", "b"]), (2, ["a", "c"]))) == ["a"]
    assert names(make((1, []), (2, ["a", "c"]))) == ["a", "c"]  # empty before anything was collected: skipped
    assert names(make((1, ["a"]), (2, []))) == []  # empty after: nothing is common
    assert names(make()) == []


def test_best_node(spark):
    grants = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "user_id long, object_id long")
    node = lambda *rows: [r.node_id for r in li.best_nodes(spark.createDataFrame(list(rows), "id long, queue_count long, minutes_ago double"), grants).collect()]
    assert node((1, 2, None), (2, 1, 9.0)) == []
    assert node((1, 2, 0.0)) == [1] and node((1, 2, 0.0), (2, 1, 0.0)) == [2] and node((1, 2, 0.0), (2, 1, 5.0)) == [1] and node((3, 1, 0.0), (2, 1, 0.0)) == [2]


def test_quota_removes_the_newest(spark):
    t = dt.datetime(2020, 1, 1)
    tasks = spark.createDataFrame([(1, 5, t, 1005.0), (2, 5, t + dt.timedelta(hours=1), 1010.0), (3, 6, t, 1.0)], "id long, owner_id long, created_at timestamp, size double")
    gone = lambda q: sorted(r.id for r in c.over_quota_tasks(tasks, spark.createDataFrame([(5, q), (6, -1.0)], "owner_id long, quota double")).collect())
    assert gone(2000.0) == [2] and gone(0.0) == [1, 2] and gone(-1.0) == [] and gone(2015.0) == []


def test_cleanup(spark):
    now = dt.datetime(2020, 1, 1, 12)
    ago = lambda h: now - dt.timedelta(hours=h)
    tasks = spark.createDataFrame([(1, True, ago(0)), (2, True, ago(2)), (3, False, ago(2))], "id long, partial boolean, created_at timestamp")
    assert [r.id for r in li.expired_partial(tasks, F.lit(now), 3).collect()] == [] and [r.id for r in li.expired_partial(tasks, F.lit(now), 1).collect()] == [2]
    own = spark.createDataFrame([(9, 1)], "id long, project_id long")
    for quota, gone in ((-1.0, []), (100.0, []), (0.0, [2])):
        projects = spark.createDataFrame([(1, False, quota, ago(2)), (2, False, quota, ago(2)), (3, False, quota, ago(0))], "id long, deleting boolean, quota double, created_at timestamp")
        assert [r.id for r in li.removable_projects(projects, own, F.lit(now), 1).collect()] == gone
    files = spark.createDataFrame([("/cache/a", ago(29 * 24)), ("/cache/b", ago(31 * 24)), ("/tmp/a", ago(23)), ("/tmp/b", now - dt.timedelta(hours=24, seconds=100))], "path string, modified timestamp")
    assert sorted(r.path for r in li.stale_files(files, F.lit(now)).collect()) == ["/cache/b", "/tmp/b"]


def test_slices_and_pages(spark):
    lines = spark.createDataFrame([(1, i) for i in range(6)], "k int, line_no int")
    got = lambda a, n: sorted(r.line_no for r in c.slice_lines(lines, a, n, "k").collect())
    assert got(2, 2) == [2, 3] and got(2, 0) == [2, 3, 4, 5] and got(1, -2) == [4, 5] and got(4, -5) == [4, 5]
    assert c.paginator(1, 35) == [1, 2, 3, 4] and c.paginator(9, 200) == [6, 7, 8, 9, 10, 11, 12] and c.paginator(1, 0) == [1]


def test_upsert_and_sync(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, c.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, c.sync(b, a, "k").collect())) == [(1, "delete"), (3, "insert")]


def test_overlap_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    boxes = [(i, x, y, x + rng.random() * 5, y + rng.random() * 5) for i in range(40) for x, y in [(rng.random() * 20, rng.random() * 20)]]
    got = {r.id: r.overlap for r in c.largest_overlap(spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")).collect()}
    for i, a, b, p, q in boxes:
        best = 0.0
        for j, e, f, g, h in boxes[:i]:
            w, v = max(0, min(p, g) - max(a, e)), max(0, min(q, h) - max(b, f))
            best = max(best, w * v / ((p - a) * (q - b) + (g - e) * (h - f) - w * v))
        assert got[i] == pytest.approx(best)
