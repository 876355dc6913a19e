"""The pipeline stage by stage against brute force, each on what its predecessor kept."""

import re

import corpus_pipeline
from tests.llm.test_operators import brute_leaks


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "sentencepiece_encoding"]
    kept = stages["quality_classifier"](spark, docs, sf_dir)
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and 0.7 * docs.count() < len(rows) < docs.count()

    kept = spark.createDataFrame(list(rows.values()), docs.schema)
    once = {}
    for i, r in sorted(rows.items(), key=lambda x: (-len(x[1].text), x[0])):
        once.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), i)
    kept = stages["exact_dedup"](spark, kept, sf_dir)
    assert {r.doc_id for r in kept.collect()} == set(once.values()) and kept.columns == docs.columns

    near = {r.doc_id: r for r in stages["near_dedup"](spark, kept, sf_dir).collect()}
    assert 0.9 * len(once) < len(near) <= len(once)

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(6).collect()]
    clean = {r.doc_id for r in stages["decontamination"](spark, spark.createDataFrame(list(near.values()), docs.schema), sf_dir).collect()}
    assert clean < near.keys()
    assert all(not brute_leaks(items, near[i].text)[1] for i in sorted(clean)[:25])
    coded = stages["sentencepiece_encoding"](spark, spark.createDataFrame([near[i] for i in sorted(clean)[:20]], docs.schema), sf_dir)
    assert coded.count() == 20 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= {*coded.columns}


def test_run(spark, sf_dir):
    small = corpus_pipeline.run(spark, sf_dir.replace("sf0.01", "sf0.001"))
    assert 50 < small.count() < 200
