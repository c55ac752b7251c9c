"""The stored vector index against an exact search."""

import re

import pytest
from pyspark.sql import functions as F

from stackroom.operators import search as S
from stackroom.sources import lists


@pytest.fixture(scope="module")
def rows(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).cache()


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("vectors"))
    lists.create(spark, out, rows, "id", "v")
    return out


def queries_of(rows, condition="id % 50 = 0"):
    return rows.where(condition).select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))


def pairs(found):
    return {(r.query_id, r.id) for r in found.collect()}


def test_recall_with_a_fifth_of_the_lists(spark, rows, path):
    queries = queries_of(rows)
    assert lists.PROBES * 5 <= lists.LISTS
    true = pairs(S.batch_semantic(rows, "v", queries, 10))
    assert len(pairs(S.ann_search(spark, path, queries, 10)) & true) / len(true) >= 0.9


def test_all_lists_and_rows_give_the_exact_result(spark, rows, path):
    queries, n = queries_of(rows, "id < 5"), rows.count()
    exact = {(r.query_id, r.id, r.distance, r["rank"]) for r in S.batch_semantic(rows, "v", queries, 7).collect()}
    assert {(r.query_id, r.id, r.distance, r["rank"]) for r in S.ann_search(spark, path, queries, 7, probes=lists.LISTS, keep=n).collect()} == exact


def test_every_row_is_in_as_many_lists_as_it_has_copies(spark, rows, path):
    codes, vectors = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors")
    assert codes.groupBy("id").count().where(f"count <> {lists.COPIES}").isEmpty() and vectors.count() == rows.count() == codes.select("id").distinct().count()
    assert vectors.where(F.length("code") != lists.SLICES).isEmpty()


def test_other_partitions_are_not_read(spark, rows, path):
    plan = S.ann_search(spark, path, queries_of(rows, "id = 0"), 3)._jdf.queryExecution().optimizedPlan().toString()
    asked = re.search(r"list#\d+ (?:IN \(|INSET )([\d, ]+)", plan).group(1)
    assert len(set(re.findall(r"\d+", asked))) == lists.PROBES
    physical = S.ann_search(spark, path, queries_of(rows, "id = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"FileScan parquet \[[^\]]*code#.*PartitionFilters: \[list#", physical)


def test_later_rows_need_no_new_model(spark, rows, path, tmp_path):
    out = str(tmp_path / "v")
    lists.save_model(spark, out, lists.load_model(spark, path))
    lists.add(spark, out, rows.where("id % 2 = 0"), "id", "v", 0)
    for _ in range(2):
        lists.add(spark, out, rows.where("id % 2 = 1"), "id", "v", 1)
    queries = queries_of(rows, "id < 3")
    assert pairs(S.ann_search(spark, out, queries, 10)) == pairs(S.ann_search(spark, path, queries, 10))


def test_edges(spark, tmp_path):
    out = str(tmp_path / "v")
    data = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [1.0]), (7, []), (8, [2.0, 0.0, 0.0]), (9, [1.0, 1.0, 0.0])]
    rows = spark.createDataFrame(data, "id long, v array<float>")
    lists.create(spark, out, rows, "id", "v", lists=4, slices=2, copies=9)
    queries = queries_of(rows, "true")
    got = [(r.query_id, r.id, r.distance) for r in S.ann_search(spark, out, queries, 2, probes=4).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 0.0), (1, 8, 0.0), (2, 2, 0.0), (2, 9, 0.292893), (3, 1, 1.0), (3, 2, 1.0), (8, 1, 0.0), (8, 8, 0.0), (9, 9, 0.0), (9, 1, 0.292893)]
    assert S.ann_search(spark, out, queries.where("query_id = 6"), 2).isEmpty()
    with pytest.raises(ValueError):
        lists.fit(rows.where("id = 4"), "v")


def test_queries_in_several_blocks(spark, rows, path, monkeypatch):
    queries = queries_of(rows, "id % 10 = 0")
    whole, approximate = pairs(S.batch_semantic(rows, "v", queries, 5)), pairs(S.ann_search(spark, path, queries, 5))
    monkeypatch.setattr(S, "BLOCK_BYTES", 64 * 8 * 9)
    monkeypatch.setattr(S, "QUERY_STEP", 4)
    assert pairs(S.batch_semantic(rows, "v", queries, 5)) == whole and pairs(S.ann_search(spark, path, queries, 5)) == approximate


def test_a_task_holds_the_candidates_of_one_step_of_queries(spark, rows, path, monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    model, keep = lists.load_model(spark, path), 20
    codes = spark.read.parquet(f"{path}/codes").select("id", "home", "list", "code").toArrow().to_batches(max_chunksize=100)
    x = np.array([r.v for r in rows.orderBy("id").limit(500).collect()])
    block = SimpleNamespace(value=(pa.array(range(len(x))), x))
    probed = model.nearest_lists(lists.unit(x), lists.PROBES)
    find = lambda: list(S._nearest_by_codes(block, SimpleNamespace(value=model), "id", probed, keep)(iter(codes)))
    best = lambda found: {q: sorted(s for _, s in sorted(g))[-5:] for q, g in _by_query(found).items()}
    whole = find()
    assert max(b.num_rows for b in whole) <= lists.QUERY_STEP * keep
    monkeypatch.setattr(S, "HELD_CODES", 300)
    monkeypatch.setattr(S, "HELD_ROWS", 50)
    assert best(find()) == best(whole)


def _by_query(batches):
    out = {}
    for batch in batches:
        for r in batch.to_pylist():
            out.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    return {q: [(i, s) for i, s in found.items()] for q, found in out.items()}
