import hashlib
import math
import re
import zlib

from stackroom.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def features(text):
    words = WORD.findall((text or "").encode().lower())
    return words, [zlib.crc32(b" ".join(words[i : i + n])) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def by_hand(docs, target):
    made = [(i, *features(t)) for i, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, _, f in made:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gains = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, words, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for rank, r in enumerate(may[: 5 * len(may) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(spark, docs, target):
    rows = resampling.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows.collect()), key=str)


EDGES = [
    (1, None), (2, ""), (3, " .. "), (4, "One"), (5, "one TWO"), (6, "a a a a"), (7, "Ünï-code été ÉTÉ \u0000 x\U0001f600y"), (8, "lone\nline  two"), (9, "it's a'b"),
    (None, "no id " * 12), (10, "long " * 3000 + "tail"), (11, "w" * 70_000),
]


def test_edges_against_hand_made_sample(spark):
    docs = EDGES + [(100 + i, " ".join(f"w{(i * j) % 17}" for j in range(1, 19 + i % 4))) for i in range(150)]
    target = ["w1 w2 w3 w4 lone line", None, "", "été"]
    assert resampled(spark, docs, target) == by_hand(docs, target)


def test_windows_and_slices_do_not_matter(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array([t for _, t in EDGES])

    def total():
        out = np.zeros((len(EDGES), 10000), int)
        for a, part in resampling._slices(texts):
            for document, bucket in resampling.ngram_buckets(part, 10000, 3):
                if bucket is not None:
                    np.add.at(out, (a + document, bucket), 1)
        return out

    whole = total()
    for row, (_, text) in zip(whole, EDGES, strict=True):
        assert row.tolist() == np.bincount(features(text)[1], minlength=10000).tolist()
    monkeypatch.setattr(resampling, "WINDOW_WORDS", 3)
    monkeypatch.setattr(resampling, "SLICE_BYTES", 10)
    assert (total() == whole).all()


def test_ties_take_the_smaller_id_and_ranks_have_no_gaps(spark):
    weighed = spark.range(3000).selectExpr("CAST(id % 50 AS LONG) AS doc_id", "25L AS n_words", "0L AS weight").repartition(9)
    rows = [r for r in resampling.draw(weighed).collect() if r.rank]
    assert sorted(r.rank for r in rows) == list(range(1, 151))
    assert [(-r.score, r.doc_id) for r in sorted(rows, key=lambda r: r.rank)] == sorted((-r.score, r.doc_id) for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none.select("text")).collect() == []
    docs = [(i, f"some words {i} " * 8) for i in range(40)]
    assert resampled(spark, docs, []) == by_hand(docs, [])
    assert resampled(spark, [(1, "few words")], ["few"]) == by_hand([(1, "few words")], ["few"])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10, 1, 2)], "doc_id long, text string, _part int, weight int")
    rows = resampling.resample(docs, docs.select("text")).collect()
    assert rows[0].n_features == 30 + 29 + 28 and rows[0].n_words == 30


def test_query(spark, small):
    rows = sorted((tuple(r) for r in resampling.op13_importance_resampling(spark, small).collect()), key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert rows == by_hand(docs, [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
