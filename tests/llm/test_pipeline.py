"""The corpus pipeline, stage by stage against plain versions."""

import hashlib

import numpy as np

import corpus_pipeline
from riskmap.llm import quality
from tests.llm import brute


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs, given = spark.read.parquet(str(tmp_path / name)), docs
        after = {r["doc_id"] for r in docs.collect()}
        if name == "quality":
            model = quality.train(given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = model.predict(np.array([quality.statistics(t) for t in before.values()]))
            want = {i for i, p in zip(before, scores) if p >= quality.THRESHOLD}
        elif name == "exact_dedup":
            want = {max(i for i in before if brute.lower(before[i]) == t) for t in map(brute.lower, before.values())}
        elif name == "near_duplicates":
            want = {i for i, (_, c) in brute.jaccard_components(before, 80, 5).items() if i == c}
        elif name == "decontaminate":
            items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
            want = {i for i, (_, h, _) in brute.contamination(before, items).items() if not h}
        else:
            want = set(before)
            assert {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()} == {
                i: hashlib.sha256(t.encode()).hexdigest() for i, t in before.items()}
        assert after == want, name
        assert name == "pieces" or docs.columns == columns


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "token_ids" in out.columns
