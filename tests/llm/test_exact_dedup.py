import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from stackroom.llm import exact_dedup as E
from stackroom.llm.common import possible


def located(docs):
    """A locator must name the same content whenever it is read: here the rows are numbered once."""
    rows = [(r.doc_id, r.text, f"row {i}") for i, r in enumerate(docs.collect())]
    return docs.sparkSession.createDataFrame(rows, "doc_id long, text string, locator string")


def brute(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(fold)].append(doc_id)
    return {doc_id: (max(x for x in ids if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for doc_id in ids}


ROWS = [(1, "Same"), (2, "sAME"), (3, "Émile"), (4, "émile"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (9, "alone")] + [(i, "hot") for i in range(100, 900)]


def test_groups(spark, docs_of):
    out = E.exact_duplicates(located(docs_of(ROWS)).repartition(4)).collect()
    expected = brute(ROWS)
    assert {r.id: (r.keep_id, r.group_size, r.digest) for r in out} == expected
    assert all(r.kept == (r.id == r.keep_id) for r in out)


def test_groups_beyond_the_broadcast(spark, docs_of, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    out = E.exact_duplicates(located(docs_of(ROWS))).collect()
    assert {r.id: (r.keep_id, r.group_size, r.digest) for r in out} == brute(ROWS)


def test_ids_of_another_type(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("b", "X", "2"), (None, "x", "3")], "doc_id string, text string, locator string")
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in E.exact_duplicates(rows).collect()} == {("a", "b", 3, False), ("b", "b", 3, True), (None, "b", 3, False)}


def test_possible_keeps_all_known_keys_and_few_others(spark):
    every = spark.range(20_000).selectExpr("concat('k', id) AS k", "id AS _bucket2")
    kept = {r.k for r in possible(every, "k", every.where("_bucket2 % 7 = 0").select("k")).collect()}
    assert {f"k{i}" for i in range(0, 20_000, 7)} <= kept and len(kept) < 3200


def test_the_session_keeps_its_settings(spark, docs_of):
    before = dict(spark.conf.getAll)
    E.exact_duplicates(located(docs_of(ROWS[:4]))).collect()
    assert dict(spark.conf.getAll) == before


def test_equal_digests_of_different_texts(spark, docs_of, monkeypatch):
    """With a digest that collides for everything, the comparison of full bytes still finds the true groups."""
    monkeypatch.setattr(E.F, "sha2", lambda *_: F.lit("same"))
    rows = [(i, t) for i, t in enumerate(["a", "b", "A", "c", "b", "a", "d"])]
    out = {r.id: (r.keep_id, r.group_size, r.kept) for r in E.exact_duplicates(located(docs_of(rows))).collect()}
    assert out == {0: (5, 3, False), 1: (4, 2, False), 2: (5, 3, False), 3: (3, 1, True), 4: (4, 2, True), 5: (5, 3, True), 6: (6, 1, True)}


def test_repeated_rows_and_nulls(spark, docs_of):
    out = E.exact_duplicates(located(docs_of([(1, "a"), (1, "a"), (None, "a"), (None, "b")]))).collect()
    assert sum(r.kept for r in out) == 2 and {(r.keep_id, r.group_size) for r in out} == {(1, 3), (None, 1)}


def test_empty(spark, docs_of):
    assert E.exact_duplicates(located(docs_of([]))).isEmpty()


def test_state_goes_on_from_its_checkpoint(spark, docs_of, tmp_path):
    schema = "id long, digest string, locator string"
    paths = [f"file://{tmp_path}/{x}" for x in ("in", "check", "out")]
    for rows in ([(1, "x", "p"), (2, "y", "q")], [(9, "x", "r"), (3, "z", "s")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(paths[0])
        got = E.keep_latest(spark, paths[0], spark.createDataFrame([], schema).schema, paths[1], paths[2])
    assert {(r.digest, r.best.id, r.group_size) for r in got.collect()} == {("x", 9, 2), ("y", 2, 1), ("z", 3, 1)}
