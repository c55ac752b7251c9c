import math
import re
from collections import Counter

from checks import same_rows
from stackroom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def by_hand(docs, items, k=50):
    """The ranking of (id, text) rows, term by term."""
    first = lambda i: (i is not None, i)
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    rows = []
    for item, terms in asked.items():
        scored = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            scored.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t]), first(doc)))
        best = sorted(s for s in scored if s[0] < 0)[:k]
        rows += [(item, rank, doc[1], -score) for rank, (score, doc) in enumerate(best, 1)]
    return sorted(rows, key=str)


def found(spark, docs, items, **options):
    return sorted(map(tuple, lexical.lexical_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()), key=str)


EDGES = [
    (1, "The cat, the CAT; cats!"), (2, "a cat"), (3, None), (4, ""), (5, "...\n\t"), (6, "catégorie cat\u0000the ÉTÉ été Été"), (7, "cat"), (7, "cat"), (8, "cat"),
    (None, "cat dog"), (9, "dog " * 3000 + "cat"), (10, "the_cat x1 1x \U0001f600 \U0001f600cat"), (11, "ıI"), (12, "x" * 100_000),
]
ASKED = [(1, "CAT the"), (2, "été"), (3, "absent"), (4, None), (5, "!!"), (6, "cat cat \U0001f600"), (None, "dog"), (None, "1x"), (2, "dog"), (7, "x" * 100_000)]


def test_edges_against_hand_made_ranking(spark):
    assert found(spark, EDGES, ASKED) == by_hand(EDGES, ASKED)


def test_ties_and_cut_over_many_partitions(spark):
    docs = [(i, "alpha beta" if i % 3 else "alpha beta gamma") for i in range(400)]
    items = [(1, "alpha"), (2, "beta gamma")]
    rows = spark.createDataFrame(docs, DOCS).repartition(7)
    got = lexical.lexical_search(rows, spark.createDataFrame(items, ITEMS), k=20).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(docs, items, 20)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.item_id == 1] == [i for i in range(400) if i % 3][:20]


def test_blocks_of_items_give_the_same(spark):
    items = [(i, f"cat w{i} dog the") for i in range(12)]
    assert found(spark, EDGES, items, pairs_per_scan=10) == by_hand(EDGES, items)


def test_other_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([("b", "cat", 1, 2), ("a", "cat", 3, 4)], "doc_id string, text string, _item int, score int")
    items = spark.createDataFrame([("q", "cat cow", 1, 1)], "item_id string, text string, term int, rank int")
    docs = docs.unionByName(spark.createDataFrame([("c", "fish", 1, 1), ("d", "fish", 1, 1)], docs.schema))
    assert [(r.item_id, r.rank, r.doc_id) for r in sorted(lexical.lexical_search(docs, items).collect(), key=lambda r: r.rank)] == [("q", 1, "a"), ("q", 2, "b")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    asked = spark.createDataFrame(ASKED, ITEMS)
    assert lexical.lexical_search(none, asked).collect() == []
    got = lexical.lexical_search(spark.createDataFrame(EDGES, DOCS), asked.where("false"))
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_query(spark, duck, small):
    same_rows(duck, lexical.op11_lexical_search(spark, small), lexical.OP11_SQL)
