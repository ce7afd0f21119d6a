from __future__ import annotations

from skyquarry import plans


def test_paths_of_more_rows_than_a_recursion_may_have(spark, sf_dir):
    bound = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(bound)
    spark.conf.set(bound, "50")
    try:
        got = plans.runnable()["f20_category_paths"](spark, sf_dir).collect()
    finally:
        spark.conf.set(bound, before)
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}

    def path(k):
        return parts[k].p_brand if k < 8 else f"{path(k // 8)} > {parts[k].p_brand}"

    assert len(parts) > 50
    assert {(r.id, r.path) for r in got} == {(k, path(k)) for k, r in parts.items() if r.p_size > 10}
