from __future__ import annotations

import random
import string

import numpy as np

from skyquarry.llm import spotsigs

from .conftest import prose, rows


def brute(data):
    """doc order: descending doc_id, ties by text, null ids last."""
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        yield i, a, a[: len(a) - len(a) // 2] + b[: len(a) // 2], b


def likeness(a: str, b: str) -> float:
    return spotsigs.likeness(spotsigs.parse(a), spotsigs.parse(b))


def test_edited_texts_and_likeness(spark, docs):
    marks = {}
    everything = {x for _, a, e, b in brute(rows()) for x in (a, e, b)}
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(sorted(everything))], "doc_id bigint, text string")
    by_id = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(texts).collect()}
    marks = {t: by_id[k] for k, t in enumerate(sorted(everything))}
    want = sorted(((i, len(a), e, marks[a], marks[e], likeness(marks[a], marks[e]), likeness(marks[a], marks[b])) for i, a, e, b in brute(rows())), key=repr)
    for parts in (1, 3, 7):
        got = sorted((tuple(r) for r in spotsigs.compare_with_next(docs, parts).collect()), key=repr)
        assert got == want


def test_edges(spark, empty, extra):
    assert spotsigs.compare_with_next(empty).collect() == []
    one = spark.createDataFrame([(1, "the house of stone and the river")], "doc_id bigint, text string")
    r = spotsigs.compare_with_next(one).collect()[0]
    assert r.near_next == 1.0 and r.edited == "the house of sto" + "the house of sto"
    assert spotsigs.compare_with_next(extra).count() == len(rows())
    assert spotsigs.fingerprint(spotsigs.np.zeros(0, "u4")) == "0:"


def words_of(text: str) -> list[tuple[str, bool, bool]]:
    """(bare word, is it an anchor, does something begin with it), one code point after the other."""
    out, begins, word = [], True, ""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    for c in lower + " ":
        if c not in " \t\n\v\f\r":
            word += c
            continue
        if word:
            bare = word.strip(string.punctuation)
            out.append((bare or word, not bare or len(bare) <= 2 or bare in spotsigs.ANCHORS, begins))
            begins, word = word[-1] in string.punctuation, ""
        begins = begins or c == "\n"
    return out


def brute_signatures(text: str) -> set[tuple]:
    words = words_of(text)
    out = set()
    for k, (w, anchor, begins) in enumerate(words):
        if anchor or begins:
            rest = [x for x, a, _ in words[k + anchor :] if not a]
            out.add((w if anchor else "\n", *rest[: spotsigs.CHAIN]))
    return out


def texts_for_search() -> list[tuple]:
    rng, data = random.Random(5), list(rows())
    for f in range(8):
        base = prose(900 + f, 30 + 40 * f).split(" ")
        for _ in range(7):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
            data.append((1000 + len(data), " ".join(own[: len(own) - rng.randrange(3)])))
    return data


def test_signatures_against_brute_force():
    for _, t in texts_for_search():
        got, want = spotsigs.signature_sets(_one(t or ""))[0] if t else [], brute_signatures(t or "")
        assert len(got) == len(want)
    for (_, t), (_, u) in zip(texts_for_search()[15:], texts_for_search()[16:], strict=False):
        a, b = (spotsigs.signature_sets(_one(x or "."))[0] for x in (t, u))
        x, y = brute_signatures(t or "."), brute_signatures(u or ".")
        assert spotsigs.likeness((len(a), a), (len(b), b)) == len(x & y) / len(x | y)


def test_pruned_likeness_is_the_same_from_the_threshold_on():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 900, rng.integers(1, 900))).astype(np.uint32) for _ in "ab")
        x, y = set(a.tolist()), set(b.tolist())
        true = len(x & y) / len(x | y)
        for least in (0.0, 0.2, 0.5, true):
            assert spotsigs.likeness((len(a), a), (len(b), b), least) == (true if true >= least else 0.0)


def test_similar_documents_against_brute_force(spark, empty):
    data = texts_for_search()
    sets = [brute_signatures(t or "") for _, t in data]
    parent = list(range(len(data)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(data):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    want = [(data[i][0], len(a), least[find(i)] if a else data[i][0], sum(a == b for b in sets) - 1 if a else 0) for i, a in enumerate(sets)]
    got = spotsigs.similar_documents(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert spotsigs.similar_documents(empty).collect() == []


def test_likeness_of_long_texts_is_exact(spark):
    rng = random.Random(7)
    words = [rng.choice(["the", "of", "le"]) if rng.random() < 0.3 else f"word{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join(words), " ".join([*words[:700], "edited", *words[701:]]), " ".join([*words[:30], *(f"also{k}" for k in range(1400))])]
    docs = spark.createDataFrame([(3 - k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    r = {x.doc_id: x for x in spotsigs.compare_with_next(docs, 2).collect()}
    a, b, c = (set(spotsigs.signature_sets(t)[0].tolist()) for t in map(_one, texts))
    assert min(len(a), len(b)) > 100 and a != b and a & c
    assert r[3].near_next == len(a & b) / len(a | b) < 1 and r[1].near_next == len(a & c) / len(a | c) > 0
    assert len({x.fingerprint for x in r.values()}) == 3
    assert set(spotsigs.parse(r[3].fingerprint)[1].tolist()) == a
    made = set(spotsigs.signature_sets(_one(r[3].edited))[0].tolist())
    assert r[3].near_edited == len(a & made) / len(a | made)


def _one(text):
    from skyquarry.llm.text import as_texts
    import pyarrow as pa

    return next(t for _, _, t in as_texts(pa.array([text])))
