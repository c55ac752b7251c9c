"""The stored index of segments, and searches over it, against the same searches over all postings."""

import random

import pytest
from pyspark.sql import functions as F

from stackroom.functions import analyze
from stackroom.operators import indexed
from stackroom.operators import search as S
from stackroom.sources import segments
from stackroom.streaming import jobs

WORDS = "rei casa carta lei civil norma artigo pedra ponte rio mar sol lua vento chuva folha".split()
SCHEMA = "id long, lib long, first string, rest string"


def corpus(n, seed, first_id=0):
    pick = random.Random(seed)
    text = lambda most: " ".join(pick.choices(WORDS, range(len(WORDS), 0, -1), k=pick.randint(0, most)))
    return [(first_id + i, i % 3, text(4), text(2 ** pick.randint(1, 7))) for i in range(n)]


def rows_of(spark, docs):
    made = spark.createDataFrame(docs, SCHEMA)
    return made.select("id", "lib", F.length("rest").alias("size"), analyze.placed_words([("first", "A"), ("rest", "C")]).alias("words"))


def postings_of(spark, docs):
    return analyze.postings(spark.createDataFrame(docs, SCHEMA), [("first", "A"), ("rest", "C")], ["id"])


def as_set(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def by_rank(found, k):
    """Ids and scores of the first k ranks, ties at the edge included."""
    rows = sorted(((-r.text_rank, r.id) for r in found.collect()))
    return [r for r in rows if len(rows) <= k or r[0] <= rows[k - 1][0]]


@pytest.fixture(scope="module")
def docs():
    return corpus(400, 1)


@pytest.fixture(scope="module")
def made(spark, docs, tmp_path_factory):
    index = segments.create(spark, str(tmp_path_factory.mktemp("index")), "id", ("lib",), buckets=3, positions=True, updates=True, docs_per_block=16)
    return segments.update(index, rows_of(spark, docs), 0)


def test_index_holds_all_postings(spark, docs, made):
    wanted = postings_of(spark, docs)
    assert as_set(made.postings(), "id", "term", "pos", "label") == as_set(wanted, "id", "term", "pos", "label")
    assert as_set(made.document_frequencies(), "term", "df") == as_set(wanted.groupBy("term").agg(F.countDistinct("id").alias("df")), "term", "df")
    assert made.docs == 400 and segments.latest(spark, made.path) == made


@pytest.mark.parametrize("words", [["rei"], ["folha", "chuva"], ["rei", "casa", "folha", "missing"], ["missing"], []])
def test_broad_search(spark, docs, made, words):
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    wanted = S.text_scores(postings_of(spark, docs), terms, ["id"])
    for k in (1, 7, 1000):
        assert by_rank(indexed.indexed_search(made, words, k), k) == by_rank(wanted, k)
    inside = wanted.join(spark.createDataFrame(docs, SCHEMA).where("lib = 1"), "id", "left_semi")
    assert by_rank(indexed.indexed_search(made, words, 5, where=F.col("lib") == 1), 5) == by_rank(inside, 5)
    allowed = spark.createDataFrame(docs, SCHEMA).where("id % 7 = 0").select("id")
    assert by_rank(indexed.indexed_search(made, words, 5, allowed=allowed), 5) == by_rank(wanted.join(allowed, "id", "left_semi"), 5)


def test_more_blocks_than_a_filter_takes(spark, docs, made):
    wanted = S.text_scores(postings_of(spark, docs), spark.createDataFrame([("rei",), ("casa",)], "term string"), ["id"])
    assert by_rank(indexed.indexed_search(made, ["rei", "casa"], 5, most_blocks=3), 5) == by_rank(wanted, 5)


def test_strict_search_phrases_and_exclusions(spark, docs, made):
    post = postings_of(spark, docs)
    terms = spark.createDataFrame([("rei",), ("lei",), ("mar",)], "term string")
    assert by_rank(indexed.indexed_search(made, ["rei", "lei", "mar"], 6, "strict"), 6) == by_rank(S.text_scores(post, terms, ["id"], "strict"), 6)
    for text in ('casa "rei casa" -sol', '"carta rei" OR lei', "lei NOT rei", '"missing rei"', "-rei"):
        wanted = S.text_search(lambda words: post.where(F.col("term").isin(words)), text, spark, ["id"])
        assert by_rank(indexed.search_text(made, text, 6), 6) == by_rank(wanted, 6), text


def test_batch_search(spark, docs, made):
    terms = spark.createDataFrame([(q, w) for q, ws in {1: ["rei", "folha"], 2: ["lua"], 3: ["missing"], 4: WORDS}.items() for w in ws], "query_id long, term string")
    columns = ["query_id", "id", "text_rank", "rank"]
    assert as_set(indexed.indexed_batch(made, terms, 5), *columns) == as_set(S.batch_textual(postings_of(spark, docs), terms, 5), *columns)
    assert indexed.indexed_batch(made, terms.where("query_id = 3"), 5).isEmpty() and indexed.indexed_batch(made, terms.where("false"), 5).isEmpty()


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    df._jdf.queryExecution().executedPlan().execute().count()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(node.plan())
        elif name == "FileSourceScanExec":
            yield node.metrics().apply("numOutputRows").value()
        else:
            for i in range(node.children().size()):
                yield from walk(node.children().apply(i))

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_few_blocks_of_a_frequent_term_are_read(spark, tmp_path):
    docs = [(i, 0, "", " ".join(["rei"] * (1 + i % 200))) for i in range(4000)]
    index = segments.update(segments.create(spark, str(tmp_path / "i"), "id", ("lib",), buckets=2, docs_per_block=20), rows_of(spark, docs), 0)
    blocks = index.of_terms("bounds", ["rei"]).count()
    bounds = {r.block: r.best for r in index.of_terms("bounds", ["rei"]).collect()}
    found = indexed.indexed_search(index, ["rei"], 10)
    assert [i for _, i in by_rank(found, 10)] == list(range(199, 4000, 200))
    tenth = 200 * 0.2
    kept = sum(b >= tenth - 1e-6 for b in bounds.values())
    # The last scan gives the blocks at or above the threshold, a small part of all.
    assert kept < blocks / 10 and "In(block" in found._jdf.queryExecution().executedPlan().toString()
    read = index.of_terms("blocks", ["rei"]).where(F.col("block").isin([b for b, best in bounds.items() if best >= tenth - 1e-6])).agg(F.sum("n")).first()[0]
    assert read < 4000 / 10


def test_updates_equal_a_rebuild(spark, tmp_path):
    index = segments.create(spark, str(tmp_path / "i"), "id", ("lib",), buckets=2, positions=True, updates=True, docs_per_block=8)
    state = {}
    for batch in range(7):
        new = corpus(60, 10 + batch, first_id=batch * 30)
        gone = [i for i in range(batch * 30 - 40, batch * 30 - 20) if i in state]
        state.update({d[0]: d for d in new})
        state = {i: d for i, d in state.items() if i not in gone}
        deleted = spark.createDataFrame([(i,) for i in gone], "id long")
        index = segments.update(index, rows_of(spark, new), batch, deleted)
        assert segments.update(index, rows_of(spark, corpus(5, 99)), batch) == index, "a repeated batch changes nothing"
        assert len(index.segments) <= 4 and index.docs == len(state)
    wanted = postings_of(spark, list(state.values()))
    assert as_set(index.postings(), "id", "term", "pos", "label") == as_set(wanted, "id", "term", "pos", "label")
    assert as_set(index.document_frequencies(), "term", "df") == as_set(wanted.groupBy("term").agg(F.countDistinct("id").alias("df")), "term", "df")
    assert as_set(index.document_frequencies(["rei", "folha"]), "term", "df") == as_set(wanted.where("term IN ('rei', 'folha')").groupBy("term").agg(F.countDistinct("id").alias("df")), "term", "df")
    terms = spark.createDataFrame([("rei",), ("folha",)], "term string")
    assert by_rank(indexed.indexed_search(index, ["rei", "folha"], 9), 9) == by_rank(S.text_scores(wanted, terms, ["id"]), 9)
    segments.vacuum(index)
    assert as_set(segments.latest(spark, index.path).postings(), "id", "term", "pos", "label") == as_set(wanted, "id", "term", "pos", "label")


def test_merges_keep_segments_few_and_rewrite_dead_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LEAST_DOCS", 10)
    index = segments.create(spark, str(tmp_path / "i"), "id", ("lib",), buckets=1, positions=True, updates=True)
    for batch in range(9):
        index = segments.update(index, rows_of(spark, corpus(12, batch, first_id=batch * 12)), batch)
    assert len(index.segments) <= 3 and index.docs == 108
    index = segments.update(index, rows_of(spark, []), 9, spark.range(70).select("id"))
    assert index.docs == 38 and all(2 * s.dead <= s.docs for s in index.segments)
    assert {r.id for r in index.postings().select("id").distinct().collect()} <= set(range(70, 108))


def test_index_without_words_groups_or_rows(spark, tmp_path):
    empty = segments.create(spark, str(tmp_path / "i"), "id")
    assert indexed.indexed_search(empty, ["rei"], 3).collect() == [] and empty.docs == 0
    one = segments.update(empty, rows_of(spark, [(1, None, None, ""), (2, None, "Rei", None)]).drop("lib"), 0)
    assert [r.id for r in indexed.indexed_search(one, ["rei"], 3).collect()] == [2]
    null_group = segments.create(spark, str(tmp_path / "n"), "id", ("lib",), positions=True)
    null_group = segments.update(null_group, rows_of(spark, [(1, None, "rei", "x"), (2, 1, "rei", "x")]), 0)
    assert sorted(r.id for r in indexed.indexed_search(null_group, ["rei"], 3).collect()) == [1, 2]
    terms = spark.createDataFrame([(1, "rei")], "query_id long, term string")
    assert indexed.indexed_batch(null_group, terms, 5).count() == 2


def test_stream_of_changes(spark, tmp_path):
    source, checkpoint, path = (str(tmp_path / n) for n in ("source", "checkpoint", "index"))
    segments.create(spark, path, "doc_id", positions=True, updates=True)
    schema = "doc_id long, text string, deleted boolean, v long"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.maintain_index(jobs.arriving(spark, source, spark.createDataFrame([], schema).schema), path, checkpoint, order="v").awaitTermination()
        return {(r.doc_id, r.term) for r in segments.latest(spark, path).postings().collect()}

    assert run([(1, "rei", False, 1), (2, "lei", False, 1), (1, "casa", False, 2), (3, "", False, 1)]) == {(1, "casa"), (2, "lei")}
    assert run([(2, None, True, 1), (4, "mar sol", False, 1), (1, "rio", False, 1), (9, None, True, 1)]) == {(1, "rio"), (4, "mar"), (4, "sol")}
    assert {(r.term, r.df) for r in segments.latest(spark, path).document_frequencies().collect()} == {("rio", 1), ("mar", 1), ("sol", 1)}


def test_texts_are_shuffled_and_postings_are_not(spark, tmp_path, monkeypatch):
    """Between a batch's documents and the written postings there is one exchange, below which no word is made."""
    plans, write = [], segments._write_segment

    def seen(snapshot, row, name):
        plans.append(row._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0])
        return write(snapshot, row, name)

    monkeypatch.setattr(segments, "_write_segment", seen)
    path, source = str(tmp_path / "index"), str(tmp_path / "source")
    segments.create(spark, path, "doc_id", positions=True, updates=True)
    spark.createDataFrame([(1, "rei casa", False), (2, "lei rei", False)], "doc_id long, text string, deleted boolean").coalesce(1).write.parquet(source)
    jobs.maintain_index(jobs.arriving(spark, source, spark.read.parquet(source).schema), path, str(tmp_path / "checkpoint")).awaitTermination()
    (plan,) = plans
    above, below = plan.split("Exchange ")
    assert "FlatMapGroupsInArrow" in above and "[^\\p{L}\\p{N}_]+" in above and "[^\\p{L}\\p{N}_]+" not in below


def test_a_block_leaves_its_task_as_a_row_for_each_term(spark, tmp_path, monkeypatch):
    """Also where documents are so long that fewer make a block."""
    monkeypatch.setattr(segments, "BLOCK_SIZE", 64)
    docs = [(i, i % 2, "rei lua rei", "lua") for i in range(40)]
    index = segments.create(spark, str(tmp_path / "i"), "id", ("lib",), buckets=2, positions=True)
    placed = rows_of(spark, docs).withColumn("block", segments._block(segments._size_class(F.col("size")), "id", {0: 40}, 1024))
    assert segments._block_rows(placed, index).count() == 2 * placed.select("lib", "block").distinct().count()
    made = segments.update(index, rows_of(spark, docs), 0)
    assert as_set(made.postings(), "id", "term", "pos", "label") == as_set(postings_of(spark, docs), "id", "term", "pos", "label")
    assert made._read("blocks").select("block").distinct().count() > 1
