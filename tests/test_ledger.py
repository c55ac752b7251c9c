"""Stored tables that batches change, and the streams that keep them up."""

import pytest
from pyspark.sql import functions as F

from checks import same_rows
from stackroom.operators import chunking as C
from stackroom.plans.registry import ORACLES, QUERIES
from stackroom.sources import ledger
from stackroom.streaming import jobs

import __spark_entry__  # noqa: F401  registers the queries


def test_upsert_delete_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda data: spark.createDataFrame(data, "id long, part long, v string")
    held = lambda: sorted((r.id, r.part, r.v) for r in ledger.read(spark, path).collect())
    with pytest.raises(ValueError):
        ledger.read(spark, path)
    first = rows([(i, p, "a") for i in range(200) for p in range(2)] + [(None, 0, "n")])
    ledger.upsert(spark, path, first, ["id"], first, 0)
    wanted = {(i, p, "a") for i in range(200) for p in range(2)} | {(None, 0, "n")}
    assert set(held_rows := ledger.read(spark, path).collect()) == wanted and len(held_rows) == 401
    change = rows([(5, 0, "b"), (None, 0, "m"), (300, 0, "c")])
    gone = change.select("id").union(spark.createDataFrame([(7,), (999,)], "id long"))
    for _ in range(2):
        ledger.upsert(spark, path, change, ["id"], gone, 1)
    wanted = {(i, p, v) for i, p, v in wanted if i not in (5, 7, None)} | {(5, 0, "b"), (None, 0, "m"), (300, 0, "c")}
    assert set(map(tuple, ledger.read(spark, path).collect())) == wanted
    written = spark.read.parquet(f"{path}/rows").where("version = 2").select("slice").distinct().count()
    assert written <= 5, "only slices of changed keys are written"
    everything = ledger.read(spark, path).select("id").distinct()
    ledger.upsert(spark, path, rows([]), ["id"], everything, 2)
    assert held() == []
    ledger.upsert(spark, path, rows([(1, 1, "z")]), ["id"], rows([(1, 1, "z")]), 3)
    ledger.vacuum(spark, path)
    assert held() == [(1, 1, "z")]


def test_ingest_equals_the_batch_and_repeats_change_nothing(spark, small, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    changed = docs.where("doc_id % 9 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" more\nwords"))).alias("text"))

    def run(rows, place):
        if rows is not None:
            rows.write.mode("append").parquet(source)
        jobs.ingest(jobs.arriving(spark, source, docs.schema, files=2), out, place, r"\n").awaitTermination()
        return {tuple(r.asDict().values())[:7] + (tuple(r.vector),) for r in ledger.read(spark, out).collect()}

    made = lambda d: {tuple(r.asDict().values())[:7] + (tuple(r.vector),) for r in jobs.embedding_rows(d, r"\n").collect()}
    assert run(docs.where("doc_id < 120").repartition(3), checkpoint) == made(docs.where("doc_id < 120"))
    run(docs.where("doc_id >= 120").coalesce(1), checkpoint)
    after = run(changed.coalesce(1), checkpoint)
    state = docs.join(changed.select("doc_id"), "doc_id", "left_anti").union(changed.where("text IS NOT NULL"))
    assert after == made(state)
    # A stream that lost its checkpoint runs all its batches again: the ledger has them.
    assert run(None, str(tmp_path / "again")) == after


def test_words_of_odd_texts_equal_sql(spark, tmp_path):
    """Marks that cleaning drops, texts without words, none at all, and texts that begin as titles of parts do."""
    import duckdb

    texts = ["{{box|a b c}} some [[Category:X y]] text <!-- not seen --> end", "", " \n ", None, "Parte 1\nfew words", "Parte 1\n" + "word " * 500, "one\x0btwo three", "== == ===\n[[a b|c]]"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(duck, QUERIES["st1_stream_ingest"](spark, str(tmp_path)), ORACLES["st1_stream_ingest"])


def summary_by_hand(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted(t[1:] for t in turns if t[0] == conv)
        asked = [i for i, t in enumerate(mine) if t[1] == "user"]
        with_response = sum(i + 1 < len(mine) and mine[i + 1][1] == "assistant" and mine[i + 1][2] is not None for i in asked)
        if asked:
            out[conv] = (len(asked), with_response, len(asked) - with_response, mine[asked[0]][2], mine[asked[-1]][2], round(with_response / len(asked), 6))
    return out


def test_summaries_of_turns_in_any_order(spark, tmp_path):
    import random

    pick = random.Random(8)
    turns = [(c, t, pick.choice(["user", "assistant", "system"]), pick.choice([f"{c}-{t}", None]) if pick.random() < 0.1 else f"{c}-{t}") for c in range(12) for t in pick.sample(range(40), pick.randint(1, 30))]
    turns = [(c, t, r, x if r != "user" else f"{c}-{t}") for c, t, r, x in turns] + [(99, 0, "assistant", "alone")]
    pick.shuffle(turns)
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = "conv_id long, turn long, role string, text string"
    for part in range(3):
        spark.createDataFrame(turns[part::3], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.conversation_summaries(jobs.arriving(spark, source, spark.createDataFrame([], schema).schema), out, checkpoint, piece=7).awaitTermination()
        seen = [t for p in range(part + 1) for t in turns[p::3]]
        got = {r.conv_id: tuple(r)[1:] for r in jobs.summaries_of(ledger.read(spark, out)).select("conv_id", "total", "with_response", "without_response", "first", "last", "rate").collect()}
        assert got == summary_by_hand(seen)


def test_vectors_of_repeated_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, ""), (3, None)], "id long, text string")
    got = C.embed(docs, ["id"], "text", dimension=8).collect()
    assert sorted(r.id for r in got) == [1, 1, 2, 3] and all(len(r.vector) == 8 for r in got)
    assert all(abs(sum(x * x for x in r.vector) - (r.id == 1)) < 1e-6 for r in got)
    assert C.hash_features(docs, ["id"], "text", 8).count() == 4


def test_model_is_given_batches(spark):
    def load():
        import numpy as np

        return lambda texts: np.stack([[len(str(t)), len(texts)] for t in texts]).astype(np.float32)

    docs = spark.createDataFrame([(i, "x" * i if i else None) for i in range(25)], "id long, text string").coalesce(1)
    got = {r.id: r.vector for r in C.embed(docs, ["id"], "text", C.model_function(load, 10)).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: float(i) for i in range(25)} and max(v[1] for v in got.values()) <= 10


def test_summaries_without_python_tasks_and_turns_that_come_again(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = "conv_id long, turn long, role string, text string"
    batches = [
        [(1, 2, "user", "c"), (1, 9, "assistant", "j"), (None, 0, "user", None), (2, 1, "system", "s"), (3, None, "user", "x")],
        [(1, 8, "user", "i"), (1, 0, "user", "a"), (1, 2, "user", "C"), (None, 1, "assistant", "b")],
        [(1, 0, "user", "A"), (1, 9, "assistant", None), (1, 3, "assistant", "d"), (2, 2, "user", "q"), (2, 2, "user", "p")],
    ]
    wanted = [{1: (1, 1, "c", "c"), None: (1, 0, None, None)}, {1: (3, 1, "a", "i"), None: (1, 1, None, None)}, {1: (3, 1, "A", "i"), None: (1, 1, None, None), 2: (1, 0, "q", "q")}]
    for rows, want in zip(batches, wanted, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = jobs.conversation_summaries(jobs.arriving(spark, source, spark.createDataFrame([], schema).schema), out, checkpoint, piece=4)
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]  # keys are no calls of Python
        got = {r.conv_id: (r.total, r.with_response, r.first, r.last) for r in jobs.summaries_of(ledger.read(spark, out)).collect()}
        assert got == want
