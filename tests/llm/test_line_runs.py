"""op13 against counting in Python, in one batch and in many; odd rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyquarry.llm import line_runs
from tests.llm.conftest import EXTRA, SCHEMA, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def expected(texts, least, chars=1):
    texts = [(i, (t or "").split("\n")) for i, t in texts]
    docs = Counter(k for _, lines in texts for k in {key(x) for x in lines})
    gone = {k for k, n in docs.items() if n >= least and len(k) >= chars}
    return sorted(((i, len(lines), sum(key(x) in gone for x in lines), "\n".join(x for x in lines if key(x) not in gone)) for i, lines in texts), key=repr)


def odd():
    shared = "\xa0Same line\t", "SAME LINE", "  same line \r", "É line", "é line", "\x1cEdge"
    made = [(100 + k, "\n".join([*shared[: 1 + k % 6], f"own {k}", "", "twice", "twice"])) for k in range(30)]
    return [*rows(), *made, (100, made[0][1]), (None, made[1][1]), (None, None), (7, "\n\n"), (8, "a\nb\n"), (9, "\n".join(str(k % 3000) for k in range(9000)))]


def run(spark, parts, texts, least, schema=SCHEMA, chars=1):
    docs = spark.createDataFrame(texts, schema).repartition(3)
    batches = [docs.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(parts)) == k) for k in range(parts)]
    return sorted((tuple(r) for r in line_runs.drop_common_lines(batches, docs, least, chars).collect()), key=repr)


@pytest.mark.parametrize("parts,least,chars", [(1, 10, 1), (7, 10, 1), (5, 2, 3)])
def test_lines_of_many_documents_go(spark, parts, least, chars):
    assert run(spark, parts, odd(), least, chars=chars) == expected(odd(), least, chars)


def test_extra_columns_and_empty_tables(spark):
    own = [(i, t, "en", None, 1, 1, "x", 2, "y", "z", 3, 4, "f", "t", "k") for i, t in odd()]
    assert run(spark, 2, own, 10, EXTRA) == expected(odd(), 10)
    assert run(spark, 2, [], 10, EXTRA) == []


def test_levels_are_compacted_and_removed(spark):
    runs = line_runs.Runs(spark, 3, fanout=3)
    for k in range(10):
        runs.add(spark.createDataFrame([(k, f"common\nown {k}\npair {k // 2}")], SCHEMA))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    rows = {r.h1: r.docs for name in runs.levels[2] for r in spark.table(name).collect()}
    common = spark.range(1).select(F.xxhash64(F.lit("common"))).first()[0]
    assert rows[common] == 3  # settled by the first compaction, not counted again
    assert [r.h1 for r in runs.common().collect()] == [common]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skyquarry_run")]


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    plan = line_runs.drop_common_lines([docs], docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
