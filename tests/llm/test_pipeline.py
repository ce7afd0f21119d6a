from __future__ import annotations

import re

import corpus_pipeline
from skyquarry.llm import quality_rules

from .test_quality import brute as counts
from .test_setsketch import brute as components


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near-duplicates", "repeated passages", "packing"]
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, sf_dir)
        rows = df.collect()
        if k < 4:
            assert df.columns == docs.columns
            docs = spark.createDataFrame(rows, df.schema)
        out[name] = rows

    base = {i for i, r in before.items() if (c := counts(r.text))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    assert {r.doc_id for r in out["quality rules"]} == base  # so few labels certify nothing: test_rules_need_evidence
    assert len(out["quality classifier"]) >= 0.8 * len(out["quality rules"])
    kept = components([(r.doc_id, r.text) for r in out["quality classifier"]], 5, 80)
    assert sorted(r.doc_id for r in out["near-duplicates"]) == [i for i, _, c in sorted(kept) if i == c]
    for r in out["repeated passages"]:
        assert r.n_chars == len(r.text) and set(re.findall(r"\S+", r.text)) <= set(re.findall(r"\S+", before[r.doc_id].text))
    total = {r.doc_id: r.doc_tokens for r in out["packing"]}
    assert set(total) == {r.doc_id for r in out["repeated passages"]}
    assert sum(total.values()) == sum(r.length for r in out["packing"])
    again = corpus_pipeline.run(spark, sf_dir).collect()  # other partitions, so other cuts of the same ids
    assert {r.doc_id: r.doc_tokens for r in again} == total
    assert sum(r.length for r in again) == sum(total.values())


def test_stages_on_odd_tables(spark, extra, empty, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(5, 1, 0), (None, 0, 0), (13, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for df in (extra, empty):
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, folder)
            if k < 4:
                assert docs.columns == extra.columns
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() > 0) == (df is extra)


def test_rules_need_evidence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert all(not by for by in quality_rules.calibrate(quality_rules.features(docs), labels).values())
