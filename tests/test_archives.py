from __future__ import annotations

import contextlib
import io

from skyquarry.sources import archives


def test_many_small_archives_share_batches(spark, monkeypatch):
    rows = [(f"a{i}", f"{j}.txt", f"{i}/{j}".encode() * j) for i in range(40) for j in range(5)]
    rows += [("a0", "0.txt", b"~"), (None, "x", b"x"), ("a0", None, b"x"), ("b", "null.txt", None)]
    packed = archives.archived(spark.createDataFrame(rows, "archive string, member string, content binary"))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        packed.explain()
    assert "FlatMapGroupsInPandas" not in plan.getvalue()  # a call a group
    want = {("b", "null.txt", 0, b"")} | {(f"a{i}", f"{j}.txt", len(f"{i}/{j}") * j, f"{i}/{j}".encode() * j) for i in range(40) for j in range(5)}
    for most in (10_000, 1):
        monkeypatch.setattr(archives, "OUTPUT_ROWS", most)
        got = archives.members(packed).collect()
        assert len(got) == len(want) and {(r.archive, r.member, r["size"], bytes(r.content)) for r in got} == want


def test_unreadable_archives_are_rows_with_errors(spark):
    got = archives.members(spark.createDataFrame([("bad", b"no zip"), ("none", None)], "archive string, content binary")).collect()
    assert [(r.archive, r.member, r.content, bool(r.error)) for r in got] == [("bad", None, None, True), ("none", None, None, True)]
