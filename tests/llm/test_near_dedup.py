import random
from collections import defaultdict

import numpy as np
import pytest

from stackroom.llm import near_dedup as N
from stackroom.llm.components import components


def brute_classes(docs, idf):
    """Components of all pairs whose weighted Jaccard similarity is high enough; equal texts are one."""
    weighted = [N.weighted_shingles(t, idf) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            (sa, wa), (sb, wb) = weighted[i], weighted[j]
            _, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
            shared = np.minimum(wa[ia], wb[ib]).sum()
            whole = wa.sum() + wb.sum() - shared
            if (docs[i] or "") == (docs[j] or "") or (whole and shared / whole >= N.SIMILARITY):
                root[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(docs)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def classes(rows):
    groups = defaultdict(set)
    for r in rows:
        groups[r.class_id].add(r.did)
    return {frozenset(g) for g in groups.values()}


def edited(text, every, seed):
    rng = random.Random(seed)
    return " ".join(f"e{rng.random()}" if rng.random() < 1 / every else w for w in text.split())


def test_classes_equal_brute_force(spark, docs_of, words):
    texts = [words(1000 * i, 1000 * i + 300) for i in range(12)]
    texts += [edited(texts[i % 12], 60 + 30 * (i % 5), i) for i in range(60)]
    texts += [texts[0], texts[0], "", None, "three short words", "three short words", "other short words", words(5, 9)]
    passage = words(90_000, 90_100)
    texts += [f"{passage} {words(20_000 + 200 * i, 20_000 + 200 * i + 60)}" for i in range(40)]
    docs = docs_of(list(enumerate(texts)))
    idf = N.idf_table(docs)
    rows, _ = N.near_duplicates(docs)
    assert classes(rows.collect()) == brute_classes(texts, idf)


def test_pairs_in_a_family_of_strangers(spark, docs_of, words, monkeypatch):
    """All members share a base at a similarity under the threshold; few pairs share some words more."""
    monkeypatch.setattr(N, "DF_FLOOR", 0.1)
    monkeypatch.setattr(N, "DEALT", 16)
    base = words(0, 160)
    texts = [f"{base} {words(1000 + 20 * i, 1008 + 20 * i)}" for i in range(150)]
    for i in range(20):
        head = words(9000 + 10 * i, 9003 + 10 * i)
        texts += [f"{base} {head} {words(20_000 + 20 * n, 20_005 + 20 * n)}" for n in (2 * i, 2 * i + 1)]
    rows, _ = N.near_duplicates(docs_of(list(enumerate(texts))))
    assert classes(rows.collect()) == {frozenset([i]) for i in range(150)} | {frozenset([150 + 2 * i, 151 + 2 * i]) for i in range(20)}


def test_recall_of_thousands_of_links(spark, docs_of, words):
    """Pairs at similarities from just above the threshold: at least nine of ten are found."""
    texts = [words(100 * i, 100 * i + 60) for i in range(2500)]
    texts += [" ".join([*t.split()[: 60 - i % 5], *words(10**6 + 9 * i, 10**6 + 9 * i + i % 5).split()]) + (" more" if i % 5 == 0 else "") for i, t in enumerate(texts)]
    docs = docs_of(list(enumerate(texts)))
    idf = N.idf_table(docs)
    rows, _ = N.near_duplicates(docs)
    class_of = {r.did: r.class_id for r in rows.collect()}
    links = 0
    for i in range(2500):
        (sa, wa), (sb, wb) = N.weighted_shingles(texts[i], idf), N.weighted_shingles(texts[2500 + i], idf)
        shared = wa[np.isin(sa, sb)].sum()
        links += shared / (wa.sum() + wb.sum() - shared) >= N.SIMILARITY
    found = sum(class_of[i] == class_of[2500 + i] for i in range(2500))
    assert links > 2000 and found >= 0.999 * links and len(set(class_of.values())) == 5000 - found


def test_document_frequencies(spark, docs_of, words, monkeypatch):
    """Counted by documents, whatever the chunks; weights differ by frequency."""
    monkeypatch.setattr(N, "CHUNK", 100)
    texts = [f"{words(0, 20)} {words(0, 20)} {words(100 * i, 100 * i + 9)}" for i in range(40)] + [words(0, 10)] * 10
    often, idf, other = N.idf_table(docs_of(list(enumerate(texts))))
    known = dict(zip(often.tolist(), idf.tolist(), strict=True))
    first, later = N.shingle_hashes(words(0, 5))[0], N.shingle_hashes(words(12, 17))[0]
    assert known[int(first)] == pytest.approx(np.log1p(50 / 50)) and known[int(later)] == pytest.approx(np.log1p(50 / 40)) and other == pytest.approx(np.log1p(50 / 5))


def test_rare_shingles_have_weights_of_their_own(spark, docs_of, words, monkeypatch):
    """Shingles of one, of two and of forty of four hundred documents differ, whatever the chunks and ranges; the operator's
    weights are those that brute force gives."""
    monkeypatch.setattr(N, "CHUNK", 1000)
    monkeypatch.setattr(N, "RANGE", 1000)
    texts = [f"{words(9 * (i % 10), 9 * (i % 10) + 9)} {words(1000 + 9 * (i // 2), 1009 + 9 * (i // 2))} {words(9000 + 9 * i, 9009 + 9 * i)}" for i in range(400)]
    docs = docs_of(list(enumerate(texts)))
    shingles, idf, _ = N.idf_table(docs)
    known = dict(zip(shingles.tolist(), idf.tolist(), strict=True))
    for start, df in ((0, 40), (1000, 2), (9000, 1)):
        assert known[int(N.shingle_hashes(words(start, start + 5))[0])] == pytest.approx(np.log1p(400 / df))
    held = N.in_chunks(docs.selectExpr("unhex(md5(text)) AS node", "doc_id AS did", "doc_id AS row", "text"))
    for r in N._sketches(held, 400).collect():
        assert np.array_equal(np.frombuffer(r["weights"], np.float32), N.weighted_shingles(texts[r.did], (shingles, idf, 0.0))[1])


def test_ids_of_another_type(spark, words):
    docs = spark.createDataFrame([("b", words(0, 50)), ("a", words(0, 50)), (None, words(0, 50)), (None, "own")], "doc_id string, text string")
    got = sorted(((r.did or "", r.class_id or "", r.class_size, r.kept) for r in N.near_duplicates(docs)[0].collect()))
    assert got == [("", "", 1, True), ("", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False)]
    assert {r.doc_id for r in N.stage(spark, docs, "").collect()} == {"a", None}


def test_long_text_in_blocks_has_the_same_sketch(spark, docs_of, words, monkeypatch):
    docs = docs_of([(1, words(0, 3000)), (2, words(0, 100))])
    idf = N.idf_table(docs)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"node": [b"1", b"2"], "did": [1, 2], "row": [0, 1], "text": [words(0, 3000), words(0, 100)]})
    whole = next(N._sketch([batch], idf)).column("bands").to_pylist()
    monkeypatch.setattr(N, "BLOCK", 500)
    assert next(N._sketch([batch], idf)).column("bands").to_pylist() == whole


def test_sampling_agrees_with_weighted_jaccard():
    rng = np.random.default_rng(3)
    sampler = N.Sampler(samples=2000, seed=5)
    shingles = rng.integers(0, 2**63, 400, dtype=np.uint64)
    wa, wb = rng.gamma(2, 1, 400).astype(np.float32), rng.gamma(2, 1, 400).astype(np.float32)
    wa[:60] = wb[:60]
    least = [sampler.least(shingles, np.log(w), np.zeros(1, np.intp))[:, 0] for w in (wa, wb)]
    assert (least[0] == least[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)


def test_stage_keeps_one_row_of_each_class(spark, docs_of, words):
    text = words(0, 200)
    rows = [(5, text), (3, edited(text, 150, 1)), (9, text), (9, text), (None, text), (7, words(500, 700)), (8, None), (10, "")]
    docs = docs_of(rows).selectExpr("*", "'a' AS node", "1 AS did", "2 AS kept")
    kept = N.stage(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept)[-3:] and len(kept) == 3
    assert {r.node for r in kept} == {"a"} and kept[0].asDict().keys() == set(docs.columns)


def test_empty(spark, docs_of):
    rows, links = N.near_duplicates(docs_of([]))
    assert rows.isEmpty() and links.isEmpty()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and len(got) == 121
