"""The pipeline's stages and the registered queries."""

import corpus_pipeline
from studybank.llm import decontam, jaccard, queries
from studybank.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-stage"))
    assert all(x.columns == docs.columns for x in out[:-1])
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in out]
    for before, after in zip(ids, ids[1:5]):
        assert set(after) <= set(before)
    kept = out[2]
    assert jaccard.classes(kept).filter("links > 0").count() == 0
    assert decontam.contaminated(out[3], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert sorted(ids[4]) == sorted(ids[5])


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
