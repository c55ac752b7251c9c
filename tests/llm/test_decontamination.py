import re

from stackroom.llm import decontamination as D


def shingles(text, n=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def contains(text, item):
    own = shingles(item)
    length = len(next(iter(own))) if own else 0
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    there = {tuple(w[i : i + length]) for i in range(len(w) - length + 1)} if length else set()
    return len(own & there) / len(own) if own else 0


def test_equals_brute_force(spark, docs_of, words):
    items = [(1, words(0, 40)), (2, words(100, 120)), (3, "Three little words"), (4, "one"), (5, ""), (6, None), (7, words(0, 300)), (8, words(0, 40))]
    broken = words(0, 40).split()
    broken[20] = "zz"
    docs = [
        (1, words(900, 1200) + " " + words(0, 40) + "\n" + words(1300, 1400)), (2, words(0, 40).upper().replace(" ", ", ")), (3, " ".join(broken)),
        (4, "so THREE little. words!"), (5, "one"), (6, ""), (7, None), (8, words(100, 116)), (9, words(100, 119)), (10, words(0, 260)), (10, words(100, 120)),
        (11, words(2000, 9000) + " " + words(0, 300) + " " + words(9000, 12000)), (None, words(100, 120)),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, round(r.containment, 6)) for r in D.contained_items(docs_of(docs), table).collect()))
    expected = sorted((d or 0, i, round(contains(t, s), 6)) for d, t in docs for i, s in items if contains(t, s) >= 0.8)
    assert got == expected and (3, 1, round(contains(docs[2][1], items[0][1]), 6)) in got


def test_item_without_id(spark, docs_of, words):
    table = spark.createDataFrame([(1, words(0, 40)), (None, words(100, 120)), (None, words(200, 260))], "item_id long, text string")
    docs = docs_of([(1, words(100, 120) + " " + words(200, 260)), (2, words(0, 40)), (3, words(300, 340))])
    got = D.contained_items(docs, table).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.shared, r.n_shingles) for r in got) == [(1, 0, 72, 72), (2, 1, 36, 36)]


def test_empty_sides(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(docs_of([(1, "a b c d e f")]), none).isEmpty()
    assert D.contained_items(docs_of([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).isEmpty()


def test_without_broadcast(spark, docs_of, words, monkeypatch):
    import stackroom.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame([(1, words(0, 60))], "item_id long, text string")
    assert [(r.doc_id, r.shared) for r in D.contained_items(docs_of([(1, words(0, 100)), (2, words(40, 100))]), table).collect()] == [(1, 56)]


def test_stage(spark, small, docs_of):
    bench = spark.read.parquet(f"{small}/benchmark.parquet").where("item_id = 0").first().text
    docs = docs_of([(1, f"ahead {bench} behind"), (2, "clean words"), (None, None), (2, bench)]).selectExpr("*", "1 AS _text", "2 AS item_id")
    left = D.stage(spark, docs, small)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.select("doc_id", "text").collect()) == [(0, None), (2, "clean words")]


def test_partitions_choose_sketches():
    assert [D.hashes_of(p) for p in range(12)] == [24] * 6 + [32, 40, 48, 56, 56, 56]
    assert D.least_hits(24) < D.least_hits(32) < D.least_hits(56) and D.least_hits(24) == 7


def test_items_of_every_size(spark, docs_of, words, monkeypatch):
    """Whole, four fifths, and half of items from 3 to 1500 shingles, inside a long text; with and without the broadcast."""
    sizes = [3, 20, 30, 70, 150, 300, 700, 1500]
    items = [(i, words(10_000 * i, 10_000 * i + n + 4)) for i, n in enumerate(sizes, 1)]
    cut = lambda i, n, share: words(10_000 * i, 10_000 * i + 4 + -(-n * share // 10))
    around = words(900_000, 903_000)
    docs = [(100 * i + share, f"{around} {cut(i, n, share)} {around}") for i, n in enumerate(sizes, 1) for share in (10, 8, 5)]
    expected = {(100 * i + share, i) for i, n in enumerate(sizes, 1) for share in (10, 8)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (D.BROADCAST_ROWS, 0):
        monkeypatch.setattr(D, "BROADCAST_ROWS", most)
        assert {(r.doc_id, r.item_id) for r in D.contained_items(docs_of(docs), bench).collect()} == expected
