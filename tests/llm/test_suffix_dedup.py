from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from skyquarry.llm import suffix_dedup as sd

from .conftest import bag, rows


def brute(data, length):
    seen = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in data]
    for _, b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


@pytest.mark.parametrize("hold", [1 << 19, 40])
def test_edge_rows(docs, extra, hold):
    s = sd.Settings(hold=hold, hold_suffixes=hold)
    want = brute(rows(), 200)
    assert bag(sd.remove_repeats(docs, s, digest=True), *COLUMNS) == want
    assert bag(sd.remove_repeats(extra, s, digest=True), *COLUMNS) == want


def test_empty_and_kept_bytes(spark, empty):
    assert sd.remove_repeats(empty).collect() == []
    part = "abcdefghij" * 30
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame([(1, "x" + part), (2, part + "y"), (3, "alone")], "doc_id bigint, text string")).collect()}
    assert bytes(got[1].kept) == b"x" and bytes(got[2].kept) == b"y" and got[3].kept is None


def test_random_pieces_of_few_letters(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    s = sd.Settings(length=24, seed=8, hold=500, hold_suffixes=100)
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    assert bag(sd.remove_repeats(df, s, digest=True), *COLUMNS) == brute(data, 24)


def test_merge_gives_sorted_suffixes_and_prefixes():
    rng = random.Random(1)

    class Plain:
        def __init__(self, keys):
            self.keys, self.n, self.i, self.key = keys, len(keys), 0, keys[0]

        def next(self):
            self.i += 1
            if self.i >= self.n:
                return -1
            self.key = self.keys[self.i]
            return sd.common(self.keys[self.i - 1], self.key, 0)

    for k in (1, 2, 3, 7):
        lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(k)]
        which, number, shared = sd.merge([Plain(x) for x in lists])
        keys = [lists[w][n] for w, n in zip(which, number, strict=True)]
        assert keys == sorted(x for own in lists for x in own)
        assert shared[1:] == [sd.common(a, b, 0) for a, b in zip(keys, keys[1:], strict=False)]


def test_anchor_depends_on_the_string_alone():
    s = sd.Settings(length=20, seed=5)
    data = np.frombuffer(("abcab" * 30 + "xyz" * 20).encode(), np.uint8)
    _, place, lo, hi = sd.anchors(data, s)
    offset = {}
    for p, a, b in zip(place, lo, hi, strict=True):
        for k in range(a, b + 1):
            text = data[k : k + 20].tobytes()
            assert 0 <= p - k <= 15 and offset.setdefault(text, p - k) == p - k
    assert sum(hi - lo + 1) == len(data) - 19


