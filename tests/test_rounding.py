from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from skyquarry import plans
from skyquarry.functions.ieee import half_away, rounded

VALUES = [128.605, 136.295, 0.285, 1.005, 2.675, -128.605, -0.001, -0.0, 0.0, 2.5, -2.5, 0.49999999999999994, 1e17, float("inf"), float("nan"), None]


@pytest.mark.parametrize("digits", [0, 2, 4, 6])
def test_rounds_as_the_sql_does(spark, digits):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v double")
    got = [tuple(r) for r in df.select("i", half_away(F.col("v"), digits), rounded(F.col("v"), digits)).orderBy("i").collect()]
    want = [(i, *duckdb.execute(f"SELECT round(?::DOUBLE, {digits}), round(?::DOUBLE, {digits}) + 0.0::DOUBLE", [v, v]).fetchone()) for i, v in enumerate(VALUES)]
    assert repr(got) == repr(want)


def test_disk_sizes_at_binary_halves(spark, tmp_path):
    con = duckdb.connect()
    con.sql("SELECT i AS o_orderkey, i AS o_custkey, 'F' AS o_orderstatus, v::DOUBLE AS o_totalprice, TIMESTAMP '2000-01-01' AS o_orderdate, '1' AS o_orderpriority FROM (VALUES (1, 128605), (2, 136295), (3, 153545), (4, 500)) t(i, v)").write_parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, plans.runnable()["f14_disk_sizes"](spark, str(tmp_path)).select("id", "gb", "ok").collect()))
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert got == sorted(con.execute(f"SELECT id, gb, ok FROM ({plans.SQL['f14_disk_sizes']})").fetchall())


def test_extents_keep_the_sign_of_zero(spark, tmp_path):
    con = duckdb.connect()
    con.sql("SELECT i AS c_custkey, 'n' AS c_name, 3 AS c_nationkey, v::DOUBLE AS c_acctbal, 's' AS c_mktsegment FROM (VALUES (1, -0.0::DOUBLE), (2, -0.001), (3, -700.001), (4, 0.0), (5, 12.345), (6, -999.85)) t(i, v)").write_parquet(f"{tmp_path}/customer.parquet")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    got = plans.runnable()["g08_extents"](spark, str(tmp_path)).orderBy("id").collect()
    assert repr([tuple(r) for r in got]) == repr(con.execute(f"SELECT id, extent FROM ({plans.SQL['g08_extents']}) ORDER BY id").fetchall())
