from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from skyquarry.llm import chaining

from .conftest import bag, prose, rows


def test_chain_is_the_best(spark):
    s = chaining.Settings(gap=0.1)
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        pts = sorted(zip(rng.integers(0, 40, n).tolist(), rng.integers(0, 40, n).tolist(), strict=True))
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best = [0.0] * n
        for i in range(n):
            before = [best[j] - s.gap * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best[i] = s.words + max([0.0, *before])
        found = chaining.chain(x, y, s)
        top = found[0]
        score = s.words * len(top) - sum(s.gap * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(top, top[1:], strict=False))
        assert score == pytest.approx(max(best))
        assert sorted(m for c in found for m in c) == list(range(n))


def test_shared_passages(docs, extra):
    got = bag(chaining.shared_passages(docs), "doc_id", "start_word", "end_word", "n_words", "other_doc_id", "repeat")
    assert got == bag(chaining.shared_passages(extra), "doc_id", "start_word", "end_word", "n_words", "other_doc_id", "repeat")
    by = {}
    for i, a, b, _, _, _ in got:
        by.setdefault(i, []).append((a, b))
    assert set(by) == {5, 6, 7, 8, 9}  # the copies, the edited copy, and the two that share a passage
    assert max(b - a for a, b in by[7]) >= 295
    assert any(abs(a - 80) <= 1 and abs(b - 170) <= 1 for a, b in by[8]) and any(abs(a - 30) <= 1 and abs(b - 120) <= 1 for a, b in by[9])
    repeats = {(i, a, b) for i, a, b, _, _, r in got if r}
    assert len({i for i, *_ in repeats} & {8, 9}) == 1 and 6 in {i for i, *_ in repeats}


def test_short_and_different_texts_share_nothing(spark, empty):
    assert chaining.shared_passages(empty).collect() == []
    data = [(1, prose(1, 45)), (2, prose(1, 45)), (3, prose(20, 300)), (4, prose(21, 300))]
    assert chaining.shared_passages(spark.createDataFrame(data, "doc_id bigint, text string")).collect() == []


def test_every_exact_passage_is_found(spark):
    passage = prose(99, 51)
    data = [(k, prose(100 + k, 60 + k) + passage + prose(200 + k, 5 * k)) for k in range(12)] + [(100 + k, prose(300 + k, 150)) for k in range(12)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    spans = chaining.shared_passages(df).collect()
    assert {r.doc_id for r in spans} == set(range(12))
    assert len({r.doc_id for r in spans if r.repeat}) == 11


def test_cut_keeps_one_occurrence_and_columns(extra, empty):
    out = chaining.cut_repeats(extra)
    assert out.columns == extra.columns
    rest = {r.doc_id: r for r in out.collect()}
    assert all(r.n_chars == len(r.text or "") for r in rest.values())
    passage = prose(2, 90).split()
    assert sum(" ".join(passage[5:85]) in " ".join((r.text or "").split()) for r in rest.values()) == 1
    untouched = {i: t for i, t in rows() if i not in (5, 6, 7, 8, 9)}
    assert all(rest[i].text == t for i, t in untouched.items())
    assert (5 in rest) + (6 in rest) + (7 in rest) == 1
    assert chaining.cut_repeats(empty).collect() == []


def test_alignment_through_gaps():
    s = chaining.Settings()
    a = np.arange(1, 121, dtype=np.uint32)
    b = np.concatenate([[901, 902], a[:60], [903, 904, 905], a[62:]]).astype(np.uint32)
    x = np.array([0, 10, 50, 70, 110])
    y = np.array([int(np.flatnonzero(b == a[i])[0]) for i in x])
    [(a0, a1, b0, b1, edits)] = chaining.align(a, b, x, y, s)
    assert (a0, a1, b0, b1, edits) == (0, 120, 2, 123, 3)


def test_alike_parts_of_a_chain_that_is_not_alike_as_a_whole():
    s = chaining.Settings()
    words = np.arange(1, 400, dtype=np.uint32)
    for sizes in ((51, 16), (51, 28), (28, 51), (51, 51, 51)):
        a, b, x, at = [], [], [], 0
        for k, n in enumerate(sizes):
            if k:
                a.append(words[:20] + 1000 * k)
                b.append(words[:20] + 1000 * k + 500)
                at += 20
            a.append(words[100 * k : 100 * k + n])
            b.append(words[100 * k : 100 * k + n])
            x += [at, at + n // 2, at + n - 5]
            at += n
        exact = np.concatenate([np.full(n, n >= 50) if j == 0 else np.zeros(20, bool) for n in sizes for j in (0, 1)])[:at]
        for side in (0, 1):
            found = np.zeros(at, bool)
            for box in chaining.align(np.concatenate(a), np.concatenate(b), np.array(x), np.array(x), s):
                found[box[2 * side] : box[2 * side + 1]] = True
                assert box[1] - box[0] >= s.least and box[4] <= 0.2 * (box[1] - box[0])
            assert found[exact].all()


def test_passage_twice_in_a_text(spark):
    passage = prose(99, 70)
    inner = passage.split()[30:35]
    for k in range(3):  # the text with two may come first or second in order
        twice = prose(400 + k, 40) + " ".join(inner) + " " + prose(410 + k, 60) + passage + prose(420 + k, 80) + passage + prose(430 + k, 30)
        data = [(1, twice), (2, prose(440 + k, 50) + passage), (3, prose(450 + k, 90) + "\n".join([prose(460 + k, 80)] * 2))]
        df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
        rest = [" ".join(r.text.split()) for r in chaining.cut_repeats(df).collect()]
        assert sum(t.count(" ".join(passage.split()[2:68])) for t in rest) == 1
        assert sum(t.count(" ".join(prose(460 + k, 80).split()[2:78])) for t in rest) == 1


def test_fragments_hide_no_exact_passage(spark):
    s, data = chaining.Settings(), []
    for k in range(15):
        passage = prose(1000 + k, 50 + 2 * k).split()
        for j, part in enumerate([passage, passage, passage, passage[:45], passage[:49], passage[-45:], passage[-49:], passage[3:48]]):
            data.append((100 * k + j, " ".join([prose(2000 + 10 * k + j, 20 + j).strip(), *part, prose(3000 + 10 * k + j, 30).strip()])))

    def runs(rows):
        found = {}
        for text in rows:
            w = text.lower().split()
            for i in range(len(w) - s.least + 1):
                key = tuple(w[i : i + s.least])
                found[key] = found.get(key, 0) + 1
        return found

    before = runs(t for _, t in data)
    assert max(before.values()) == 3
    for parts in (1, 3):
        df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(parts)
        after = runs(r.text for r in chaining.cut_repeats(df).collect())
        assert max(after.values()) == 1
        spans = {}
        for r in chaining.shared_passages(df).collect():
            spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        for i, t in data:
            w = t.lower().split()
            for p in range(len(w) - s.least + 1):
                assert before[tuple(w[p : p + s.least])] == 1 or any(a <= p and p + s.least <= b for a, b in spans.get(i, []))


def test_null_ids_clashing_names_and_wide_gaps(spark):
    text = prose(70, 120)
    df = spark.createDataFrame([(None, text, 1, 2), (None, text, 1, 2), (4, prose(71, 90), 1, 2)], "doc_id bigint, text string, node_ int, salt int")
    out = chaining.cut_repeats(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, text), (0, text), (4, prose(71, 90))])
    df = df.union(spark.createDataFrame([(9, text, 1, 2), (8, text, 1, 2)], df.schema))
    assert sorted(r.doc_id for r in chaining.cut_repeats(df).collect()) == [4, 8]
    assert {(r.doc_id, r.repeat) for r in chaining.shared_passages(df).collect()} == {(None, True), (8, False), (9, True)}


def test_edits_in_a_band():
    rng = np.random.default_rng(8)
    for _ in range(100):
        a, b = (rng.integers(0, 4, rng.integers(0, 40)) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for most in (3, 20, 60):
            assert chaining._edits(a, b, most) == min(row[-1], most + 1)


def test_recall_of_fuzzy_passages(spark):
    """Passages of 60 to 100 words of which one in ten to one in five is changed at random; those planted are known."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    data, planted = [], {}
    for k in range(80):
        n = rng.randrange(60, 101)
        passage = [word() for _ in range(n)]
        other = list(passage)
        for i in rng.sample(range(n), int(n * rng.choice([0.1, 0.15, 0.2]))):
            other[i] = word()
        for side, p in enumerate((passage, other)):
            lead = rng.randrange(30, 90)
            data.append((2 * k + side, " ".join([word() for _ in range(lead)] + p + [word() for _ in range(40)])))
            planted[2 * k + side] = (lead, lead + n)
    spans = {}
    for r in chaining.shared_passages(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    found = [any(min(b, d) - max(a, c) >= 0.5 * (b - a) for c, d in spans.get(i, [])) for i, (a, b) in planted.items()]
    assert sum(found) >= 0.9 * len(found)
    assert all(max(d, b) - min(c, a) <= b - a + 20 for i, (a, b) in planted.items() for c, d in spans.get(i, []))  # and little else


def test_fragments_hide_no_fuzzy_passage(spark):
    """Groups of a text with a passage, one with 10 or 15 % of its words changed, and n texts that quote 40 words of it, which is no passage."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    for size, quotes, changed in ((60, 0, 0.1), (60, 2, 0.1), (60, 4, 0.1), (60, 12, 0.1), (80, 12, 0.15), (100, 12, 0.15)):
        data = []
        for g in range(40):
            passage = [word() for _ in range(size)]
            other = list(passage)
            for i in rng.sample(range(size), int(size * changed)):
                other[i] = word()
            pieces = [passage[a : a + 40] for a in (rng.randrange(size - 39) for _ in range(quotes))]
            for k, part in enumerate([passage, other, *pieces]):
                data.append((100 * g + k, " ".join([word() for _ in range(rng.randrange(30, 60))] + part + [word() for _ in range(40)])))
        spans = chaining.shared_passages(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)).collect()
        assert all(r.doc_id % 100 < 2 and r.other_doc_id // 100 == r.doc_id // 100 for r in spans)  # no quote is a passage
        found = {r.doc_id // 100 for r in spans if r.repeat and r.end_word - r.start_word >= 40}
        assert len(found) >= 0.9 * 40, (size, quotes, changed, len(found))


def test_pairs_of_seeds_leave_out_repeats():
    s = chaining.Settings(near=10, far=20)
    batch = lambda names, rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
    rows = [(1, 0, 30, 60), *((1, 2, p, 1000 + p) for p in (0, 12, 25, 31, 45, 70)), (1, 2, 95, 1070), *((2, 2, p, 1000 + p) for p in (0, 12, 25, 45))]
    rows = batch(["node", "kind", "pos", "x"], rows)
    left = [tuple(r.values()) for out in chaining._left_rows([rows.slice(0, 3), rows.slice(3)], s) for r in out.to_pylist()]
    # seeds at 31 and 45 of text 1 lie in its span, 95 is of one run with 70
    assert left == [(1, p, 1000 + p, 1) for p in (0, 12, 25, 70)] + [(2, p, 1000 + p, 1) for p in (0, 12, 25, 45)]
    names = ["node", "pos", "x", "crowded"]
    both = lambda rows: {(r["a"], r["b"], r["places"]) for out in chaining._pair_rows([batch(names, rows[:2]), batch(names, rows[2:])], s) for r in out.to_pylist() if r["b"] is not None}
    assert both(left) == {(2, 1, (p << 32) | p) for p in (0, 12, 25)}  # 0-12 and 12-25 are pairs of both texts, 25-45 of the second alone
    assert both([(*r[:3], int(r[1] == 0)) for r in left]) == {(2, 1, (p << 32) | p) for p in (0, 12)}  # a pair has a crowded seed


def test_pairs_of_one_place_make_no_rows(spark):
    """Each seed is in two texts, as is one pair only; a search after one that left the same places has nothing to match."""
    s = chaining.Settings(near=10, far=20)
    seeds = [(k, p, 1000 + k + (p > 0), 1) for k in range(20) for p in (0, 12)] + [(100 + k, p, 5000 + p, 1) for k in range(2) for p in (0, 12)]
    left = spark.createDataFrame(seeds, "node bigint, pos bigint, x bigint, crowded bigint")

    def made(before):
        told, counts = chaining._told(left, before)
        rows = told.repartition("node").sortWithinPartitions("node", "pos").mapInArrow(lambda b: chaining._pair_rows(b, s, True), "route bigint, h bigint, a bigint, b bigint, places bigint")
        return {n for r in rows.collect() for n in (r.a, r.b) if n is not None}, counts

    nodes, counts = made(None)
    assert nodes == {100, 101}
    assert made(counts)[0] == set()
    assert made(counts.selectExpr("x", "if(x = 5012, n + 1, n) as n"))[0] == {100, 101}


def test_later_searches_look_only_where_places_have_gone(spark, monkeypatch):
    """After a search only the seeds that lost a place are told anew, with the result of a search of everything."""
    s = chaining.Settings(near=10, far=20)
    seeds = [(k, p, 1000 + 100 * (k // 5) + p) for k in range(20) for p in (0, 12, 25, 70)] + [(k, 99, 7) for k in (0, 19)]
    places = spark.createDataFrame(seeds, "node bigint, pos bigint, x bigint")
    spans = lambda *r: spark.createDataFrame(list(r), "node bigint, start bigint, stop bigint, partner bigint, repeat boolean, mark bigint")
    old, more = [(1, 0, 10, 2, True, None), (2, 0, 10, 1, False, None)], [(1, 10, 20, 3, True, None), (6, 0, 10, 5, False, None), (8, 60, 90, 5, True, None)]
    read, uncut = [], chaining._uncut
    monkeypatch.setattr(chaining, "_uncut", lambda places, *more: read.append(places.count()) or uncut(places, *more))
    left = chaining._left(places, spans(*old), s)
    parts, fresh = chaining._left_again([(left, None)], spans(*old, *more), spans(*more), s)
    now = chaining._held(parts, places.select("node").distinct(), "node")
    want = chaining._left(places, spans(*old, *more), s)
    names = ["node", "pos", "x", "crowded", *(f"other{k}" for k in range(chaining.LANES))]
    assert bag(now, *names) == bag(want, *names)
    assert read == [82, 3 + 4, 82]  # the places of texts 1 and 8, not all
    assert {r.node for r in fresh.collect()} == {0, 2, 3, 4, 5, 6, 7, 9}
    assert {(r.x, r.fresh) for r in now.collect() if r.x in (1012, 1170, 1112, 1070, 7)} == {(1012, 1), (1170, 1), (1112, 0), (1070, 0), (7, 0)}


def test_packed_occurrences_match_as_rows_do():
    s = chaining.Settings()
    rng = np.random.default_rng(7)
    often = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    plain, packed = [], []
    for _ in range(3):
        h, node, pos = often[rng.integers(0, 300, 2000)], rng.integers(-40, 40, 2000), rng.permutation(2000)
        h[:1500] = rng.integers(-(1 << 63), (1 << 63) - 1, 1500)  # most occur once
        order, again = chaining._ordered(h, node, pos)
        assert (order == np.lexsort((pos, node, h))).all() and len(again) == sum(n for n in np.unique(h, return_counts=True)[1] if n > 1)
        rows = list(chaining._settled(h, node, pos, s))
        plain += rows
        packed += list(chaining._packed(rows))
    rows = pa.Table.from_batches(plain).sort_by([("h", "ascending"), ("a", "ascending"), ("places", "ascending")]).combine_chunks().to_batches()
    packs = pa.Table.from_batches(packed)
    assert packs.num_rows < 0.9 * sum(r.num_rows for r in rows)
    packs = packs.sort_by([("kind", "ascending"), ("route", "ascending")]).combine_chunks().to_batches()
    made = lambda batches: sorted(tuple(r.values()) for out in chaining._match_rows(batches, s) for r in out.to_pylist())
    assert made(rows) == made(chaining._unpacked(packs)) and len(made(rows)) > 500
