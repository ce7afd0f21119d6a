"""op12 against all inner products in Python; few and many intervals, ties, copies, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquarry.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(vectors, every=50, first=5, last=3):
    rows = []
    for vec_id, x, label in vectors:
        if label is None or x is None or any(v is None or v != v or abs(v) == float("inf") for v in x):
            continue
        rows.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [int(v * 256 // 1) for v in x]))
    out = []
    for k, (a, label, q) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = sorted(((-sum(u * v for u, v in zip(q, x, strict=False)), i is None, i or 0, own) for j, (i, own, x) in enumerate(rows) if j != k), key=lambda r: r[:3])
        for s, none, i, _ in [r for r in scored if r[3] == label][:first]:
            fits = [r for r in scored if r[3] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:last]
            out += [(a, None if none else i, n, None if none2 else j, -s, -t) for n, (t, none2, j, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(seed, n, dims, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    made = [(i, [float(round(scale * (c + rng.gauss(0, 0.15)), 2)) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]
    return [(i, [float(int(v * 64)) / 64 for v in x], label) for i, x, label in made]


def odd():
    rows = vectors(3, 400, 6)
    copies = [(1000 + k, rows[0][1], k % 3) for k in range(150)]
    return [*rows, *copies, rows[50], rows[50], (None, rows[1][1], 1), (None, rows[2][1], 2), (2000, None, 1), (2050, rows[3][1], None), (2100, [0.5, None], 1), (2101, [float("nan")] * 6, 1), (2150, [float("inf")] + [0.0] * 5, 1),
            (2200, [], 1), (2250, [0.5, 0.25], 0), (-50, rows[5][1], 2), (2300, [0.5] * 9, 1), (2350, [0.0] * 6, 1)]


def run(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in negatives.hard_negatives(negatives.quantised(table), F.col("id") % 50 == 0).select(*COLUMNS).collect()), key=repr)


def test_against_all_pairs_on_odd_rows(spark):
    found, want = run(spark, odd()), expected(odd())
    assert len(want) > 50
    assert found == want


def test_few_dimensions_and_long_vectors(spark):
    rows = [(i, [v * (1 + 40000.0 * (i % 97 == 0)) for v in x], label) for i, x, label in vectors(4, 600, 2)]
    assert run(spark, rows) == expected(rows)


def test_scores_beyond_doubles(spark):
    rows = [(i, [v * 2.0**21 for v in x], label) for i, x, label in vectors(5, 120, 3)]
    assert run(spark, rows) == expected(rows)


def test_rounds_look_at_a_part_where_vectors_are_spread(spark):
    """Certified before all key intervals are read."""
    rows = spark.createDataFrame([(i, i % 2, [i * 50, 10 * (i % 7)]) for i in range(2000)], "id bigint, label bigint, x array<bigint>").withColumn("anchor", F.col("id") == 1900)
    space = negatives.fitted(rows)
    blocks = negatives.indexed(rows, space)
    a = blocks.mapInArrow(negatives._anchors, "anchor bigint, anchor_id bigint, label bigint, x binary, pivot int").withColumn("chunk", F.lit(1).cast("bigint"))
    chunk = negatives._chunks(a.withColumns({"lo": F.array(F.lit(-negatives.FAR)), "hi": F.array(F.lit(negatives.FAR))})).first().asDict()
    cells = np.array([(r.pivot, r.cell) for r in blocks.select("pivot", "cell").distinct().collect()])
    reach = negatives.Reach(space, cells, chunk)
    best = sorted((1900 * 50 * i * 50 + 10 * (1900 % 7) * 10 * (i % 7) for i in range(0, 2000, 2) if i != 1900), reverse=True)[4]
    assert reach.unseen(0.5)[0] < best


@pytest.mark.parametrize("rows", [[], [(50, None, 1)], [(50, [0.5], 1)]])
def test_nothing_to_find(spark, rows):
    assert run(spark, [(*r, "a", 1, "b") for r in rows], SCHEMA + ", id string, x int, anchor string") == []
