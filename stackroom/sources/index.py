"""A stored full-text index: postings by buckets of terms, with the number of documents of each term beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import analyze

BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write(held: DataFrame, words: Column, path: str, key: str, buckets: int, mode: str) -> None:
    """The index of held, which has a row for each key. words: array of (term, ...). Each task sorts the postings of its own
    keys and writes its part of every bucket, so that no posting is shuffled. The first of a term in its key is marked,
    and these are counted. The array of one binds the sorted words, so that they are made once."""

    def marked(s: Column) -> Column:
        return F.transform(s, lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get(s, i - 1)["term"] != w["term"], F.lit(True)).alias("first")))

    made = F.get(F.transform(F.array(F.sort_array(words)), marked), F.lit(0))
    rows = held.select(key, F.explode_outer(made).alias("_x")).where(F.col("_x.word.term").isNotNull())
    placed = rows.select(key, "_x.word.*", F.col("_x.first").alias("first"), _bucket(F.col("_x.word.term"), buckets).alias("bucket"))
    placed.sortWithinPartitions("bucket", "term", key).write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    terms = held.sparkSession.read.parquet(f"{path}/postings").where("first").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/terms")


def write_index(postings: DataFrame, path: str, key: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """postings (key, term, ...) under path/postings, and term, df (documents that hold it) under path/terms. Files are
    sorted by term, so that a search reads a few pages of the buckets of its terms."""
    word = F.struct("term", *[c for c in postings.columns if c not in (key, "term")])
    held = postings.repartition(key).groupBy(key).agg(F.collect_list(word).alias("_words"))
    _write(held, F.col("_words"), path, key, buckets, mode)


def write_texts(docs: DataFrame, path: str, key: str, fields: list[tuple[str, str]], buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """The same from texts: docs (key, columns of fields), fields (column, label). Texts are dealt to the tasks, which are a
    small part of their postings. Rows of one key are one document."""
    names = [name for name, _ in fields]
    held = docs.repartition(key).groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_texts"))
    words = F.transform("_texts", lambda row: analyze.placed_words([(row[name], label) for name, label in fields]))
    _write(held, F.flatten(words), path, key, buckets, mode)


def _of_words(spark: SparkSession, path: str, words: list[str], buckets: int) -> DataFrame:
    asked = spark.range(1).select(F.array(*[_bucket(F.lit(w), buckets) for w in words]).alias("b")).first().b if words else []
    return spark.read.parquet(path).where(F.col("bucket").isin(asked) & F.col("term").isin(words)).drop("bucket", "first")


def indexed_postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of these words; no other bucket is read."""
    return _of_words(spark, f"{path}/postings", words, buckets)


def term_statistics(spark: SparkSession, path: str, documents: int, words: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """term, df, idf = ln(1 + documents / df)."""
    terms = spark.read.parquet(f"{path}/terms").drop("bucket") if words is None else _of_words(spark, f"{path}/terms", words, buckets)
    return terms.select("term", "df", F.log1p(F.lit(documents) / F.col("df")).alias("idf"))
