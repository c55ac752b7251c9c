"""Ranked lexical search: an Aho-Corasick scan of the documents for the terms of all items, without a document index.

Items (queries) are searched in blocks of at most about PAIRS_PER_SCAN terms. A block's distinct terms make one automaton,
which is broadcast; each term stands in it between spaces, and so do a document's terms in the text that it reads, so that
only whole terms match. One pass over the documents counts every term's occurrences from the text and writes these few
numbers; document frequencies and lengths come from them. A second pass maps a document's terms to the items that ask for
them, sums scores, and keeps each task's best rows of every item.

A term is a longest run of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. The scores are those of
BM25 in whole numbers: k1 = 1, b = 0.5, see `weight_of` and `_scored`.

Defined cases: a null or wordless text has no term, is in no count and no result; a null id is an id, before all others;
rows of documents that repeat an id are ranked each; rows of items that repeat an id, null too, are one item of their joint
terms; an item without terms has no row; equal scores are in the order of the id; very long texts are read whole; an empty
table on either side gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.common import ascii_lower, python_path, table, text_of, written
from stackroom.operators.search import top_k_per_query

#: Rows that each item gets.
TOP = 50
#: Pairs of item and term that one scan searches for: what a block's automaton and its map from terms to items hold.
PAIRS_PER_SCAN = 500_000
#: Sums of (document, item) that a task holds at once.
CELLS = 1 << 22

# Bytes that no term has.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
SEPARATOR_PATTERN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPACED = bytes(0x20 if b in SEPARATORS else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATOR_PATTERN), lambda w: w != "")


def spaced(raw: bytes) -> bytes:
    """A text's terms with spaces around each."""
    return b" " + raw.translate(_SPACED) + b" "


def _as_text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def automaton_of(terms: list[bytes]) -> ahocorasick.Automaton:
    """Gives a term's number at each of its occurrences in a spaced text."""
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in enumerate(terms):
        made.add_word(_as_text(b" " + term + b" "), number)
    made.make_automaton()
    return made


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _counted(batches, automaton, key: str):
    """key, n (terms of the text), terms and tfs (of those that the automaton knows)."""
    for batch in batches:
        lengths, terms, tfs = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            raw = spaced(text.as_py() or b"")
            gap = np.frombuffer(raw, np.uint8) == 0x20
            lengths.append(int(np.count_nonzero(gap[:-1] & ~gap[1:])))
            found = Counter(map(itemgetter(1), automaton.value.iter(_as_text(raw)))) if lengths[-1] and len(automaton.value) else {}
            terms.append(np.fromiter(found.keys(), np.int32, len(found)))
            tfs.append(np.fromiter(found.values(), np.int32, len(found)))
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lengths, pa.int64()), _lists(terms, pa.int32()), _lists(tfs, pa.int32())], [key, "n", "terms", "tfs"])


def count_terms(docs: DataFrame, terms: list[bytes], key: str = "doc_id") -> DataFrame:
    """docs (key, text) -> key, n, terms (numbers in the list), tfs: whole texts, counted in one pass."""
    spark = docs.sparkSession
    python_path(spark)
    automaton = spark.sparkContext.broadcast(automaton_of(terms))
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n long, terms array<int>, tfs array<int>").fields])
    return docs.select(key, "text").mapInArrow(lambda batches: _counted(batches, automaton, key), schema)


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """A block of items: term t is asked for by items[starts[t]:starts[t + 1]], numbers in ids."""

    ids: pa.Array
    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray


def block_of(pairs: pa.Table, item: str) -> Block:
    """pairs: item, term, once each; at most PAIRS_PER_SCAN or so."""
    ids = pc.dictionary_encode(pairs[item].combine_chunks(), null_encoding="encode")
    terms = pc.dictionary_encode(pairs["term"].combine_chunks().cast(pa.binary()))
    number = terms.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(terms.dictionary)))])
    return Block(ids.dictionary, terms.dictionary.to_pylist(), starts, ids.indices.to_numpy()[order])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for every length, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _best(rows: pa.Table, key: str, k: int) -> pa.Table:
    """Of each item's rows the first k, by descending score and ascending key."""
    rows = rows.take(pc.sort_indices(rows, [("_item", "ascending"), ("score", "descending"), (key, "ascending")], null_placement="at_start"))
    items = rows["_item"].to_numpy()
    return rows.filter(pa.array(np.arange(len(items)) - np.searchsorted(items, items) < k)).combine_chunks()


def _scored(batches, search, key: str, k: int):
    """A task's best k rows of each item: _item, key, score."""
    block, weights, n_docs, total = search.value
    least = np.ones(len(block.ids), np.int64)
    best = None
    for batch in batches:
        size = np.asarray(batch.column("n"), np.int64)
        lengths = batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        m = 100 - 50 + (50 * size * n_docs) // max(total, 1)
        worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, lengths)))
        fan = block.starts[term + 1] - block.starts[term]
        # Documents are taken together as long as their sums are few.
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cost = np.cumsum(np.maximum(len(block.ids), np.add.reduceat(np.append(fan, 0), ends[:-1]) * (lengths > 0)))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(cost, np.arange(CELLS, cost[-1] + 1, CELLS)) + 1 if len(cost) else [], [len(size)]]).astype(int))
        made = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = slice(ends[a], ends[b])
            asked = block.items[_ranges(block.starts[term[part]], fan[part])]
            row = np.repeat(np.repeat(np.arange(b - a), lengths[a:b]), fan[part])
            scores = np.zeros((b - a, len(block.ids)), np.int64)
            np.add.at(scores.ravel(), row * len(block.ids) + asked, np.repeat(worth[part], fan[part]))
            row, asked = np.nonzero(scores >= least)
            made.append(pa.table({"_item": asked, key: batch.column(key).take(pa.array(a + row)), "score": scores[row, asked]}))
        if made:
            best = _best(pa.concat_tables([*([best] if best else []), *made]), key, k)
            items = best["_item"].to_numpy()
            last = np.flatnonzero(np.append(items[1:] != items[:-1], True)) if len(items) else np.zeros(0, int)
            full = np.bincount(items, minlength=len(least))[items[last]] >= k
            least[items[last[full]]] = best["score"].to_numpy()[last[full]]
    if best:
        yield from best.cast(pa.schema([("_item", pa.int64()), best.schema.field(key), ("score", pa.int64())])).to_batches()


def _search_block(docs: DataFrame, block: Block, key: str, item: str, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    counts = written(count_terms(docs, block.terms, key), "term-counts")
    # One row a term, of which a block has a bounded number.
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    n_docs, total = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(block.terms), np.int64)
    for term, df in zip(found["term"].to_pylist(), found["df"].to_pylist(), strict=True):
        weights[term] = weight_of(n_docs, df)
    search = spark.sparkContext.broadcast((block, weights, n_docs, total))
    schema = T.StructType([T.StructField("_item", T.LongType()), docs.schema[key], T.StructField("score", T.LongType())])
    rows = counts.where("n > 0").mapInArrow(lambda batches: _scored(batches, search, key, k), schema)
    top = top_k_per_query(rows, "_item", [F.col("score").desc(), F.col(key)], k)
    names = spark.createDataFrame(pa.table({"_item": pa.array(range(len(block.ids)), pa.int64()), item: block.ids}), T.StructType([T.StructField("_item", T.LongType()), items.schema[item]]))
    return top.join(F.broadcast(names), "_item").select(item, F.col("rank").cast("int").alias("rank"), key, "score")


def lexical_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", k: int = TOP, pairs_per_scan: int = PAIRS_PER_SCAN) -> DataFrame:
    """docs (key, text), items (item, text) -> item, rank (from 1), key, score: each item's k best documents."""
    pairs = written(items.select(item, F.explode(terms_of(text_of())).alias("term")).distinct(), "item-terms")
    blocks = max(1, -(-pairs.count() // pairs_per_scan))
    out = None
    for number in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == number) if blocks > 1 else pairs
        block = block_of(some.toArrow(), item)
        if block.terms:
            found = _search_block(docs, block, key, item, items, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        none = T.StructType([items.schema[item], T.StructField("rank", T.IntegerType()), docs.schema[key], T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], none)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = rf"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATOR_PATTERN}'), lambda x: x <> '')"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS w FROM documents),
t AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
p AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score FROM f JOIN t USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""
