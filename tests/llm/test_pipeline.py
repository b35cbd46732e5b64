"""The corpus pipeline on the smallest tables: every stage's rows against what its operator says."""

import corpus_pipeline
from equiscreen.llm import decontaminate, jaccard_join, suffix_dedup
from equiscreen.llm.common import materialise, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, DATA), f"test-{name}")
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == names and 0 < out.count() <= docs.count()
        if name == "near_duplicates":
            assert out.count() == jaccard_join.report(docs).select("component_id").distinct().count()
        if name == "repeated_passages":
            assert out.count() == docs.count() and suffix_dedup.report(docs).where("n_repeated = 0").join(docs, "doc_id").join(out.withColumnRenamed("text", "t"), "doc_id").where("text <> t").count() == 0
        if name == "benchmark_leaks":
            assert decontaminate.report(out, table(spark, DATA, "benchmark")).where("contaminated").count() == 0
        docs = out
