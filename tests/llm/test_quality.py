import zlib

import numpy as np
import pytest

from stackroom.llm import quality


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_flat_arrays_equal_a_walk_node_by_node():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 3)), rng.integers(0, 2, 500).astype(float)
    forest = quality.fit(x, y)

    def walk(row):
        total = forest.base
        for f, t, left, v in zip(forest.feature, forest.threshold, forest.left, forest.value, strict=True):
            at = 0
            while f[at] >= 0:
                at = left[at] + (row[f[at]] > t[at])
            total += v[at]
        return 1 / (1 + np.exp(-total))

    assert forest.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_one_class_or_no_labels():
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))) == pytest.approx([0.5, 0.5])
    assert quality.fit(np.zeros((5, 3)), np.ones(5)).score(np.zeros((1, 3)))[0] > 0.99


def test_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality.op4_quality_classifier(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out, strict=True))
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()
    held = rows.merge(labels)
    held = held[held.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_held_out_labels_are_not_read(spark, docs_of):
    docs = docs_of([(i, f"some words {i} " * (i % 7 + 1)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert a.base == b.base and np.array_equal(a.value, b.value)


def test_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "word"), (3, "word"), (None, "x " * 100_000)]).selectExpr("*", "7 AS score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 0)], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    out = quality.score_documents(docs, forest, ["doc_id", "text", "score"], "made").collect()
    assert len(out) == 5 and all(0 <= r.made <= 1 and r.score == 7 for r in out)
    assert quality.score_documents(docs.where("false"), forest, ["doc_id"]).isEmpty()
    assert quality.train(docs.where("false"), labels).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"d{i}", "good plain words here " * (5 if i % 2 else 1)) for i in range(80)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(80)], "doc_id string, quality int")
    scored = quality.score_documents(docs, quality.train(docs, labels), ["doc_id"]).collect()
    assert {r.doc_id for r in scored} == {f"d{i}" for i in range(80)} and all(0 <= r.score <= 1 for r in scored)
