from collections import Counter

import corpus_pipeline
from stackroom.llm import decontamination, near_dedup, quality
from stackroom.llm.common import table, written


def test_stages_take_effect(spark, small):
    docs = table(spark, small, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, small), "stage")
        sizes.append(docs.count())
        if name != "sharding":
            assert docs.columns == before.columns
    forest = quality.train(table(spark, small, "documents"), table(spark, small, "labels"))
    good = quality.score_documents(table(spark, small, "documents"), forest, ["doc_id"]).where(f"score >= {quality.KEEP_SCORE}").count()
    assert sizes[0] == good > sizes[1] > 0 and sizes[2] <= sizes[1] and sizes[4] == sizes[3]
    left = docs.select("doc_id", "text").distinct()
    assert decontamination.contained_items(left, table(spark, small, "benchmark")).isEmpty()
    rows, _ = near_dedup.near_duplicates(left)
    assert rows.where("class_size > 1").isEmpty()
    assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 2 and set(r.shard for r in docs.select("shard").distinct().collect()) <= set(range(8))
