import os

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_output"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert all(before[i] == t for i, t in after.items())
        if name == "mixing":
            assert set(after) == set(before) and len(rows) > len(after)
        else:
            assert len(rows) == len(after) < len(before)
        before, docs = after, spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {i for r in out for i in r.doc_ids} == set(before) and sorted(r.slot for r in out) == list(range(len(out)))
