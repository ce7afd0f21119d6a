from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyquarry.llm import packing

from .conftest import rows

PATH = packing.vocabulary("byte_bpe_50k.json")


def test_every_id_once_in_gapless_windows(docs):
    library = Tokenizer.from_file(PATH)
    out = packing.pack(docs, PATH, size=64, hold=500).collect()
    want = sorted(str([*library.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in rows())
    got, windows = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length * 4 == len(r.ids)
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [0, *np.cumsum([n for _, n in w])[:-1].tolist()]
        assert sum(n for _, n in w) <= 64
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        got[(r.doc_id, r.doc_tokens)].append(r)
    joined = []
    for (_, n), parts in got.items():
        ids = np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist()
        joined += [str(ids[i : i + n]) for i in range(0, len(ids), n)]  # repeated rows follow each other
        assert sorted(p.start for p in parts if p.start == 0)
    assert sorted(joined) == want
    total, slots = sum(r.length for r in out), 64 * len(windows)
    assert slots - total < 0.03 * slots + 3 * 64


def test_checksum_and_empty_table(docs, empty):
    r = packing.pieces(packing.pack(docs, PATH)).where("doc_id = 4").first()
    ids = Tokenizer.from_file(PATH).encode("a", add_special_tokens=False).ids + [0]
    assert (r.ids_crc32, r.length, r.doc_tokens) == (zlib.crc32(np.array(ids, "<u4").tobytes()), 2, 2)
    assert packing.pack(empty, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(4, 16), st.integers(0, 2**31))
def test_plan_is_optimal(sizes, size, seed):
    rng = random.Random(seed)
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    sentences = np.array(sorted(rng.sample(range(1, total + 1), min(total, 5))))
    costs = packing.Costs(sentence=1, anywhere=4, step=3)
    cuts = packing.plan_cuts(total, ends, sentences, size, costs, True)
    allowed = {*ends.tolist(), *sentences.tolist(), *range(0, total, 3), total}

    def price(p):
        return 0 if p in set(ends.tolist()) else 1 if p in set(sentences.tolist()) else 4

    best = {0: 0}
    for p in range(1, total + 1):
        if p in allowed:
            best[p] = min((best[q] + size - (p - q) + price(p) for q in best if p - q <= size), default=10**9)
    assert cuts[0] == 0 and cuts[-1] == total and np.diff(cuts).max() <= size
    assert sum(size - (b - a) + price(b) for a, b in zip(cuts, cuts[1:], strict=False)) == best[total]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(text):
    own, _ = packing.tokenizer(PATH)
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(text + " <|endoftext|>a") == LIBRARY.encode(text + " <|endoftext|>a", add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(PATH)
