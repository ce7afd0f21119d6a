from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from skyquarry.llm import graph, setsketch
from skyquarry.llm.text import mix

from .conftest import bag, prose, rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(data, k, percent):
    sets = [shingles(t, k) for _, t in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(data):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((data[i][0], len(sets[i]), least[find(i)]) for i in range(len(data))), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize("most", [1 << 24, 100])
def test_components(spark, docs, extra, most):
    s = setsketch.Settings(words=3, percent=85, most=most)
    first = bag(setsketch.near_duplicates(docs, s).where("representative"), "doc_id", "component_id")
    assert len(first) == len(set(first)) + 1  # document 5 is there twice
    want = brute(rows(), 3, 85)
    assert bag(setsketch.near_duplicates(docs, s), *COLUMNS) == want
    assert bag(setsketch.near_duplicates(extra, s), *COLUMNS) == want


def test_families_of_edits(spark):
    rng = random.Random(4)
    data = []
    for f in range(6):
        words = prose(f, 120).split()
        for _ in range(9):
            own = list(words)
            for _ in range(rng.randrange(0, 8)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
            data.append((len(data), " ".join(own)))
    s = setsketch.Settings(words=5, percent=80)
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    assert bag(setsketch.near_duplicates(df, s), *COLUMNS) == brute(data, 5, 80)


@pytest.mark.parametrize("limits", [{}, {"most_pairs": 10}])
def test_chains_of_edits(spark, limits):
    """Each text is like its neighbours only, so a cluster holds many pairs that are not linked."""
    data = []
    for f in range(3):
        words = prose(50 + f, 400).split()
        data += [(1000 * f + k, " ".join(words[6 * k : 6 * k + 100])) for k in range(30)]
    data += [(k, t) for k, t in ((5000, data[3][1]), (None, data[4][1]), (None, data[40][1]))]
    s = setsketch.Settings(words=3, percent=85, **limits)
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    found = setsketch.near_duplicates(df, s)
    assert bag(found, *COLUMNS) == brute(data, 3, 85)
    assert found.where("representative").count() == 3


def test_long_chain_in_memory():
    x = mix(np.arange(40_000, dtype=np.uint64))
    sets = [np.sort(x[5 * k : 5 * k + 100]) for k in range(5000)]
    begun = time.perf_counter()
    assert setsketch.resolve(list(range(5000)), sets, setsketch.Settings(percent=85)) == [0] * 5000
    assert time.perf_counter() - begun < 30


def test_empty(empty):
    assert setsketch.near_duplicates(empty).collect() == []


def test_registers_merge_and_estimate():
    s = setsketch.Settings(registers=400)
    x = mix(np.arange(4000, dtype=np.uint64))
    a, b = x[:3000], x[1000:]
    ra, rb, both = setsketch.registers([a, b, x], s)
    assert (np.maximum(ra, rb) == both).all()
    d = rb.astype(int) - ra
    guess = setsketch.estimate(np.array([(d < 0).sum()]), np.array([(d > 0).sum()]), len(a), np.array([len(b)]), s)[0]
    assert guess == pytest.approx(0.5, abs=0.07)
    assert setsketch.Settings(percent=85).rows() >= 4


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(70, i) for i in range(71, 90)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (200, None), (None, 1)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()))
    parent = {v: v for e in edges if None not in e for v in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
