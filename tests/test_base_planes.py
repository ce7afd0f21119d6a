from __future__ import annotations

import itertools

import duckdb
import pytest

from skyquarry import plans
from skyquarry.plans.terrain import RING


@pytest.mark.parametrize("method", ["plane", "average"])
def test_volumes_where_corners_have_no_height(spark, tmp_path, method):
    """The corners without heights: two sets of two, and some of three, four and all five."""
    corners = [int(y) * 100 + int(x) for x, y in RING]
    missing = [(0, 1), (2, 3), *itertools.islice(itertools.combinations(range(5), 3), 0, None, 4), (0, 1, 2, 4), (0, 1, 2, 3, 4)]
    missing = missing if method == "plane" else missing[-2:]
    for i, lost in enumerate(missing):
        at = tmp_path / str(i)
        at.mkdir()
        ids = ", ".join(str(corners[k]) for k in lost)
        con = duckdb.connect()
        con.sql(f"SELECT i AS event_id, CASE WHEN i IN ({ids}) THEN 'error' ELSE 'view' END AS event_type, (i * 7919 % 10007 / 100)::DOUBLE AS value FROM range(10000) t(i)").write_parquet(f"{at}/events.parquet")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
        got = plans.runnable()[f"r05_volume_{method}"](spark, str(at)).collect()
        assert repr([tuple(r) for r in got]) == repr(con.execute(plans.SQL[f"r05_volume_{method}"]).fetchall()), lost
