import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from stackroom.llm import packing

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def slow():
    made = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_slower_library_around_every_character(slow):
    encode = packing.byte_bpe()
    texts = [f"a{c}b {c}1{c} {c}{c}'{c}.{c}\n" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    joined = ["".join(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    assert [encode(t).tolist() for t in joined] == slow(joined)


def test_encoder_on_long_runs_and_special_strings(slow):
    encode = packing.byte_bpe()
    for text in (" " * 1_200_000 + "x", "a" * 50_000, "\n" * 9_000, "<|endoftext|> 've'll I'm", "ab \n\n  c", "Ünï​　 ١٢٣"):
        assert encode(text).tolist() == slow([text])[0]


def valid(rows, texts, slow):
    """Every document's tokens are there, cut as they should be, and sequences have no gaps and no more than 1024."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for (doc, pieces), ids in zip(by_doc.items(), slow([texts[d] or "" for d in by_doc]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 1024)))
        assert all(p.length == 1024 for p in pieces[1:]) and 1 <= pieces[0].length <= 1024
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist() and sum(p.length for p in pieces) == len(ids)
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist() and sum(p.length for p in pieces) <= 1024
    return len(by_sequence), sum(r.length for r in rows)


def test_query(spark, small, slow):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sequences, tokens = valid(packing.op12_packing(spark, small).collect(), texts, slow)
    assert sequences <= -(-tokens // 1024) + 2


def test_edges(spark, slow):
    texts = {1: None, 2: "", 3: "word " * 1023, 4: "word " * 1024, 5: "word " * 5000, 6: "<|endoftext|>", 7: "a\u0000b \U0001f600"}
    rows = packing.pack(packing.pieces_of(spark.createDataFrame(list(texts.items()), DOCS), ["doc_id"], keep_ids=False)).collect()
    valid(rows, texts, slow)
    assert packing.pack(packing.pieces_of(spark.createDataFrame([], DOCS), ["doc_id"])).isEmpty()
    same = spark.createDataFrame([(None, "a b")] * 3 + [(1, "a b")] * 2, DOCS).withColumn("piece", packing.F.lit(1)).withColumn("_row", packing.F.lit(1))
    assert packing.pack(packing.pieces_of(same, ["doc_id"])).count() == 5


def test_many_groups(spark):
    rows = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(600)], DOCS)
    packed = packing.pack(packing.pieces_of(rows, ["doc_id"]), group_pieces=100)
    spans = packing.sequences(packed, ["doc_id"]).collect()
    assert sorted(s.doc_id for r in spans for s in r.spans) == list(range(600))
    for r in spans:
        assert len(r.ids) == sum(s.length for s in r.spans) <= 1024
        assert [r.ids[s.offset + s.length - 1] for s in r.spans] == [packing.END_TOKEN] * len(r.spans)
    assert len({r.sequence_id >> 32 for r in spans}) == 6


def squares(gaps):
    return sum(n * n for n in np.bincount([g for g in gaps if g], minlength=1).tolist())


def test_each_size_goes_where_squares_are_least():
    rng = np.random.default_rng(4)
    for length in (10, 37):
        sizes = rng.integers(1, length + 1, 120)
        bins, n = packing._place(sizes, length)
        gaps = []
        for size, at in zip(sizes.tolist(), bins.tolist(), strict=True):
            choices = [squares([*gaps[:i], g - size, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= size] + [squares([*gaps, length - size])]
            gaps = gaps + [length] if at == len(gaps) else gaps
            gaps[at] -= size
            assert squares(gaps) == min(choices)
        assert n == len(gaps)


def best_fit_decreasing(sizes, length):
    gaps = np.zeros(length + 1, int)
    for size in sorted(sizes.tolist(), reverse=True):
        fits = np.flatnonzero(gaps[size:])
        gap = size + fits[0] if len(fits) else length
        gaps[gap] -= len(fits) > 0
        gaps[gap - size] += gap > size
        yield not len(fits)


def test_about_as_few_sequences_as_best_fit_decreasing_leaves():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 1025, 5000), np.minimum(1024, rng.lognormal(6, 1, 8000).astype(int) + 1), np.full(1000, 300), np.array([1024] * 10 + [1])):
        filled = np.bincount(packing.pack_sizes(sizes, 1024), sizes)
        assert filled.max() <= 1024 and filled.min() > 0
        assert len(filled) <= 1.015 * sum(best_fit_decreasing(sizes, 1024)) + 1
