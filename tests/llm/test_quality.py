from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skyquarry.llm import classifier, quality_rules
from skyquarry.llm.text import as_texts

from .conftest import bag, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs, extra, empty):
    want = sorted(((i, *brute(t)) for i, t in rows()), key=repr)
    got = quality_rules.features(docs)
    assert bag(got, "doc_id", *quality_rules.BASE) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got.collect())
    assert bag(quality_rules.features(extra), "doc_id", *quality_rules.BASE) == want
    assert quality_rules.features(empty).collect() == []


def test_upper_bound_is_exact():
    for k, n, e in ((0, 50, 0.01), (3, 200, 0.05), (10, 40, 0.2)):
        p = quality_rules.upper_bound(k, n, e)
        below = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert below == pytest.approx(e, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.1) == 1.0


def test_certification_stops_at_the_first_failure():
    assert quality_rules.certified([0, 0, 200, 0], 5000, 0.01, 0.01) == 2
    assert quality_rules.certified([0], 100, 0.01, 0.01) == 0  # too few to certify
    assert quality_rules.certified([], 5000, 0.01, 0.01) == 0


def brute_kept(measured, labels, levels, risk=0.01, error=0.05):
    """doc_id of the rows kept: rules by plain loops over documents, the binomial tail summed term by term."""
    label, signals, cuts = {}, quality_rules.SIGNALS, {k: len(v) for k, v in quality_rules.CUTOFFS.items()}
    for i, q in labels:
        if i is not None and q is not None:
            label[i] = max(label.get(i, 0), q)
    trials = {}
    for r in measured:
        if not r.base_failed and r.doc_id in label:
            key = (r.stratum, r.mark)
            trials[key] = (r, label[r.doc_id] > 0 or trials.get(key, (r, False))[1])
    chooses = {m: pick for m, pick in ((r.mark, r.pick) for r in measured)}
    orders = {}
    for s in {s for s, _ in trials}:
        part = [(r, g) for (t, m), (r, g) in trials.items() if t == s and chooses[m]]
        found = []
        for k in signals:
            gain = {i: sum((not g) - 5 * g for r, g in part if r[k] > i) for i in range(cuts[k])}
            i = max(gain, key=lambda i: (gain[i], -i))
            if gain[i] > 0:
                found.append((-gain[i], signals.index(k), k, i))
        if found:
            orders[s] = [(k, i) for _, _, k, i in sorted(found)]
    goods = {s: [r for (t, m), (r, g) in trials.items() if t == s and g and not chooses[m]] for s in orders}
    able = [s for s in orders if 0.99 ** len(goods[s]) <= error / 2]
    assert len(able) == 2 == len([s for s in orders if 0.99 ** len(goods[s]) <= error])  # so each of the two begins with half
    rules = {}
    for s in able:
        order, good = orders[s], goods[s]
        for n in range(1, len(order) + 1):
            wrong = sum(any(r[k] > i for k, i in order[:n]) for r in good)
            tail = sum(math.comb(len(good), j) * risk**j * (1 - risk) ** (len(good) - j) for j in range(wrong + 1))
            if tail > levels[s]:  # at a rate of ``risk`` so few would not be a surprise
                break
            rules[s] = order[:n]
    return rules, {r.doc_id for r in measured if not r.base_failed and not any(r[k] > i for k, i in rules.get(r.stratum, []))}


def test_kept_against_brute_force(spark):
    from pyspark.sql import functions as F

    data, labels = [], []
    for s, n in (("a", 1500), ("b", 1100), ("c", 60)):
        for i in range(n):
            doc_id = len(data)
            bad = i % 9 == 0
            text = prose(doc_id, 40)
            if bad and i % 2:
                text = re.sub(r"(\w+)", r"\1### ", text)
            elif bad:
                text = text.upper()
            elif i % 400 == 1:
                text = text.upper()  # good ones that a rule rejects
            data.append((doc_id, data[-1][1] if i % 50 == 5 else text, s))
            labels.append((doc_id, int(not bad)))
    measured = quality_rules.features(spark.createDataFrame(data, "doc_id bigint, text string, lang string"))
    rows_ = measured.withColumn("pick", F.pmod(F.xxhash64(F.lit(3), "mark"), F.lit(3)) == 0).collect()
    named = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got, why = quality_rules.calibrate(measured, named), quality_rules.certificates(measured, named)
    rules, kept = brute_kept(rows_, labels, {"a": 0.025, "b": 0.05 if why["a"]["reason"] is None else 0.025})  # a hands its level on if all its rules hold
    assert all(why[s]["bound"] <= 0.01 for s in rules) and all(not why[s]["rules"] and why[s]["reason"] for s in set(why) - set(rules))
    assert {s: list(by.items()) for s, by in got.items()} == rules and set(rules) == {"a", "b"}
    assert {r.doc_id for r in quality_rules.judge(measured, got).where("kept").collect()} == kept


def test_levels_go_to_strata_that_can_use_them():
    assert quality_rules.shares({"a": 5000, "b": 60}, 0.01, 0.05) == {"a": 0.05, "b": 0.0}  # b could certify nothing
    assert quality_rules.shares({"a": 400, "b": 370, "c": 300}, 0.01, 0.05) == {"a": 0.025, "b": 0.025, "c": 0.0}  # three parts would be too little for c
    assert quality_rules.shares({}, 0.01, 0.05) == {}
    wrong, good = {"a": [0, 1], "b": [0, 90], "c": [0]}, {"a": 5000, "b": 370, "c": 300}
    got = quality_rules.settle(wrong, good, 0.01, 0.05)
    assert got == {"a": (2, 0.025), "b": (1, 0.05), "c": (0, 0.0)}  # a hands its level on, b keeps it
    assert quality_rules.settle({"a": [0], "c": [0]}, {"a": 5000, "c": 300}, 0.01, 0.05) == {"a": (1, 0.05), "c": (1, 0.05)}


def test_every_stratum_has_rules_or_a_reason(spark):
    d = "/root/testdata/sf0.1"
    measured = quality_rules.features(spark.read.parquet(f"{d}/documents.parquet"))
    found = quality_rules.certificates(measured, spark.read.parquet(f"{d}/labels.parquet"))
    assert {"en", "de", "fr", "es"} <= set(found)
    for c in found.values():
        assert (bool(c["rules"]) and c["bound"] <= 0.01) or c["reason"]
    assert found["en"]["rules"]


def test_rules_reject_junk_and_keep_good(spark, empty):
    good = [(i, prose(i, 60), "en") for i in range(1400)]
    junk = [(5000 + i, re.sub(r"(\w+)", r"\1### ", prose(i, 60)), "en") for i in range(40)]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in junk] + [(None, 0), (7, None)], "doc_id bigint, quality int")
    measured = quality_rules.features(df)
    rules = quality_rules.calibrate(measured, labels)
    kept = {r.doc_id for r in quality_rules.judge(measured, rules).where("kept").collect()}
    assert not kept & {i for i, *_ in junk} and len(kept) >= 1390
    assert {r.doc_id for r in quality_rules.keep(df, rules).collect()} == kept
    assert quality_rules.calibrate(quality_rules.features(empty), labels) == {}
    assert quality_rules.keep(empty, {}).collect() == []


def test_query_folds(spark, sf_dir):
    out = classifier.query(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = [(r.score, labels[r.doc_id]) for r in classifier.query(spark, d).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in out if y], [s for s, y in out if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_labels_of_the_held_out_fold_play_no_part(spark, docs):
    ids = [i for i in range(1, 13)]
    kept = [i for i in ids if zlib.crc32(str(i).encode()) % 5]
    schema = "doc_id bigint, quality int"
    a = classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (3, None)], schema))
    b = classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in kept], schema))
    assert (a == b).all() and a.any()


def test_repeated_ids_add_nothing_to_the_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    once = [(i, prose(i, 30)) for i in range(40)]
    more = [(i, t if k else "\U0010ffff" + t) for i, t in once[:10] for k in range(6)]  # copies, and one later in order
    a, b = (classifier.fit(spark.createDataFrame(x, "doc_id bigint, text string"), labels) for x in (once, once + more))
    assert (a == b).all() and a.any()


def test_classifier_edges(spark, docs, extra, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    w = classifier.fit(docs, none)
    assert {r.score for r in classifier.score(docs, w).collect()} == {0.5}
    assert classifier.score(docs, w).count() == len(rows())
    assert classifier.keep(extra, w, 0.3).columns == extra.columns and classifier.keep(extra, w, 0.3).count() == len(rows())
    assert classifier.score(empty, w).collect() == []


def test_score_is_the_sparse_dot_product():
    s = classifier.Settings(bits=10)
    w = np.random.default_rng(0).normal(size=(1 << 10) + 1).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(["One two, TWO 33", ""]), pa.array([1, 0])], names=["doc_id", "text", "label"])
    want = [1 / (1 + math.exp(-(float((w[at] * x).sum()) + float(w[-1])))) for _, at, x, _ in classifier._examples([batch], s)]
    got = np.concatenate([classifier.score_texts(t, w, s) for _, _, t in as_texts(batch.column("text"))])
    assert got == pytest.approx(want, rel=1e-5)


def test_training_follows_the_updates_written_out():
    """Follow-the-regularised-leader, one coordinate after the other in plain numbers."""
    s = classifier.Settings(bits=6, epochs=2)
    rng = np.random.default_rng(3)
    rows = [(i, np.sort(rng.choice(64, 5, replace=False)), rng.uniform(0, 2, 5), int(i % 3 == 0)) for i in range(40)]
    z, n = [0.0] * 65, [0.0] * 65

    def weight(k):
        if abs(z[k]) <= s.l1:
            return 0.0
        return -(z[k] - math.copysign(s.l1, z[k])) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    order = sorted(rows, key=lambda x: (int(classifier.mix(np.array([x[0]], np.int64).view(np.uint64))[0]), x[0]))
    for _ in range(s.epochs):
        for _, at, x, label in order:
            features = [*zip(at.tolist(), x.tolist(), strict=True), (64, 1.0)]
            w = {k: weight(k) for k, _ in features}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in features)))
            for k, v in features:
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / s.alpha * w[k]
                n[k] += g * g
    assert classifier.train(rows, s) == pytest.approx([weight(k) for k in range(65)], rel=1e-5, abs=1e-7)
