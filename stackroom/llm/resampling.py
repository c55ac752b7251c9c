"""Importance resampling towards a target distribution, by hashed n-grams (Xie et al., 2023).

Features are all runs of one to ORDER consecutive words, hashed into BUCKETS. Arrow kernels lower-case, split and encode the
words of a batch; shifted codes make pairs, and pairs with the next code make triples; only distinct ones are hashed, each by
carrying its first words' CRC on. One pass over the documents sums the buckets' counts, of which a task gives one row each;
with those of the target they make the buckets' gains. A second pass sums the gains of each document's features. Gumbel
noise, drawn from a hash of the id, turns the sums into the keys of a weighted sample without replacement: the highest ones.

Ranks come from one range sort: a row's place in its range, and the sizes of the ranges before.

Defined cases: a null text has no words, no features and weight 0; a null id draws its noise from an empty id and is before
others of its score; repeated rows score alike and take a rank each; in equal scores the smaller id is before the greater; a
very long text is read whole; an empty table gives an empty result, and an empty target one of equal target counts;
further columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stackroom.llm.common import python_path, table, written

BUCKETS, ORDER = 10_000, 3
#: A document may be drawn from so many words on; of those documents, PERCENT in a hundred are.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Words whose n-grams a task holds at once.
WINDOW_WORDS = 1 << 19
#: Text that a task splits at once, but for a longer single one.
SLICE_BYTES = 8 << 20

# Fixed value: what stands between words, after lower-casing.
SEPARATOR_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _slices(texts: pa.Array):
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(SLICE_BYTES, sizes[-1], SLICE_BYTES)) + 1, [len(texts)]]).astype(int)) if len(sizes) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield a, texts.slice(a, b - a)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, each code's place among them)"""
    made = pa.array(codes).dictionary_encode()
    return made.dictionary.to_numpy(), made.indices.to_numpy()


def ngram_buckets(texts: pa.Array, buckets: int, order: int):
    """(document, bucket) arrays of all n-grams of all documents, some n-grams at a time; and, first, each one's words."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR_PATTERN)
    flat = pc.list_flatten(split).dictionary_encode()
    document = np.repeat(np.arange(len(texts)), split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    code = flat.indices.to_numpy()
    real = code != (words.index(b"") if b"" in words else -1)
    code, document = code[real].astype(np.int64), document[real]
    yield np.bincount(document, minlength=len(texts)), None
    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
    following = np.empty(len(words), object)
    following[:] = [b" " + w for w in words]
    for a in range(0, len(code), WINDOW_WORDS):
        b = min(a + WINDOW_WORDS, len(code))
        grams, hashes, at = code[a:b], crcs, np.arange(a, b)
        yield document[a:b], (hashes % buckets)[grams]
        for n in range(1, order):
            # Runs go on to the word n places later, if it is one of the same document.
            goes_on = at + n < len(code)
            at, grams = at[goes_on], grams[goes_on]
            goes_on = document[at] == document[at + n]
            at, grams = at[goes_on], grams[goes_on]
            pairs, places = _distinct(grams * len(words) + code[at + n])
            first, last = np.divmod(pairs, len(words))
            hashes = np.fromiter(map(zlib.crc32, following[last], hashes[first].tolist()), np.uint32, len(pairs))
            grams = places.astype(np.int64)
            yield document[at], (hashes % buckets)[grams]


def _bucket_counts(batches, buckets: int, order: int):
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, texts in _slices(batch.column("text")):
            for _, bucket in ngram_buckets(texts, buckets, order):
                if bucket is not None:
                    total += np.bincount(bucket, minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features in each bucket, over all of texts (text). `buckets` numbers reach the driver."""
    python_path(texts.sparkSession)
    parts = texts.select("text").mapInArrow(lambda batches: _bucket_counts(batches, buckets, order), "bucket long, n long")
    summed = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier each bucket is in the target, rounded down."""
    all_source, all_target, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + k) / ((s + 1) * (all_target + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(batches, key: str, gains, order: int):
    for batch in batches:
        n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for a, texts in _slices(batch.column("text")):
            here = slice(a, a + len(texts))
            for document, bucket in ngram_buckets(texts, len(gains.value), order):
                if bucket is None:
                    n_words[here] = document
                elif len(document):
                    # Documents are in order: the gains of each are one segment.
                    starts = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
                    weight[a + document[starts]] += np.add.reduceat(gains.value[bucket], starts)
                    n_features[a + document[starts]] += np.diff(np.append(starts, len(document)))
        yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, (n_words, n_features, weight))], [key, "n_words", "n_features", "weight"])


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", order: int = ORDER) -> DataFrame:
    """docs (key, text) -> key, n_words, n_features, weight (sum of the features' gains)."""
    python_path(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])
    return docs.select(key, "text").mapInArrow(lambda batches: _weighed(batches, key, shared, order), schema)


def draw(weighed: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed (key, n_words, weight, ...) with score and rank: 1, 2, 3, ... for those drawn, null for the others."""
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    # The id of a row in a range sort is its range's number and its place in the range.
    may = F.col("n_words") >= least_words
    ordered = scored.repartitionByRange(may.desc(), F.col("score").desc(), F.col(key)).sortWithinPartitions(may.desc(), F.col("score").desc(), F.col(key))
    placed = written(ordered.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.count_if(may).alias("_may"))
    # One row a range, of which there are as many as shuffle partitions.
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"), F.floor(F.sum("_may").over(Window.partitionBy()) * percent / 100).alias("_most"))
    rank = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn("rank", F.when(may & (rank <= F.col("_most")), rank)).drop("_part", "_place", "_start", "_most")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """docs (key, text), target (text) -> key, n_words, n_features, weight, score, rank."""
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    # The range sort reads its rows twice: written, their texts are not read again.
    return draw(written(weights(docs, gains, key), "weights"), key, percent)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
