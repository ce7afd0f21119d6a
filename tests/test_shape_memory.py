from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pyspark

from skyquarry.sources import shapes


def test_a_partition_of_shapes_is_never_whole_in_memory(spark, tmp_path, monkeypatch):
    context = SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: context))
    n, size = 20, 1000
    ring = [{"x": float(k), "y": float(k * k)} for k in range(5)]
    batches = (pa.RecordBatch.from_pydict({"parts": [[ring]] * size, "id": list(range(i * size, (i + 1) * size)), "name": ["n"] * size}) for i in range(n))
    run = shapes._saved(f"{tmp_path}/layer", shapes.POLYGON, [("id", "bigint"), ("name", "text")])
    tracemalloc.start()
    try:
        assert [b["n"].to_pylist() for b in run(batches)] == [[n * size]]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6e6
    monkeypatch.undo()
    back = shapes.read_shapefile(spark, f"{tmp_path}/layer")
    assert back.count() == n * size and back.selectExpr("sum(id)").first()[0] == n * size * (n * size - 1) // 2
