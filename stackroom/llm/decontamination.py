"""Benchmark decontamination: MinHash containment search, by DataFrame functions only.

Items are partitioned by size, in powers of two. A partition has its number of hash functions, more for larger items, and
its number of hits that make a candidate. An item is sketched by its least shingle under each of the partition's hash
functions, or by all its shingles if these are no more. A document is searched with every shingle it has: the slots it hits
estimate how much of the item it contains, however long it is itself. What reaches the item's number of hits is verified by
exact shingle containment on the words.

A shingle is five words; an item of fewer words is one shingle of all its words, looked up among the document's runs of
that length. Sketches miss a contained item with a probability below MISSED.

Defined cases: null and wordless texts neither contain nor are contained; repeated documents each count; items that
repeat an id are one item of their joint shingles, and so are those without an id; very long texts are searched whole; an
empty table on either side gives an empty result; further columns are not read, and pass through the pipeline stage. Rows
of documents are told apart by id and text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.common import BROADCAST_ROWS, maybe_broadcast, possible, table, text_of, written

SHINGLE_WORDS, CONTAINMENT, MISSED = 5, 0.8, 1e-7
#: Hash functions of items under 2**6 shingles, and what each further power of two adds, up to the last one here.
HASHES, MORE_HASHES, LAST_PARTITION = 24, 8, 9


def hashes_of(partition: int) -> int:
    """Hash functions for items of 2**partition to 2**(partition + 1) - 1 shingles."""
    return HASHES + MORE_HASHES * max(0, min(partition, LAST_PARTITION) - 5)


def least_hits(hashes: int) -> int:
    """Slots that a document with CONTAINMENT of the item hits but for a chance below MISSED."""
    chance, hits = 0.0, 0
    while (chance := chance + math.comb(hashes, hits) * CONTAINMENT**hits * (1 - CONTAINMENT) ** (hashes - hits)) < MISSED:
        hits += 1
    return hits


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def runs(words: Column, size: int, make) -> Column:
    """make(run) for every run of `size` words; none in a shorter text."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: make(F.slice(words, i, size)))).otherwise(F.array())


def own_runs(words: Column, make) -> Column:
    """An item's shingles: its runs of SHINGLE_WORDS words, or all words of a shorter one."""
    short = F.when(F.size(words) > 0, F.array(make(words))).otherwise(F.array())
    return F.when(F.size(words) >= SHINGLE_WORDS, runs(words, SHINGLE_WORDS, make)).otherwise(short)


def item_shingles(items: DataFrame, item: str) -> DataFrame:
    """item, words (of a shingle), shingle (its hash), once each."""
    split = items.select(F.col(item).alias("item"), words_of(text_of()).alias("w"))
    each = split.select("item", F.explode(own_runs(F.col("w"), lambda r: F.array_join(r, " "))).alias("words")).distinct()
    return each.select("item", "words", F.xxhash64(F.split("words", " ")).alias("shingle"), F.size(F.split("words", " ")).alias("length"))


def sketch_index(shingles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, sizes). slots: shingle, item, slots that it fills; sizes: item, n, partition, need (hits to be verified)."""
    sizes = shingles.groupBy("item").agg(F.countDistinct("shingle").alias("n")).withColumn("partition", F.least(F.floor(F.log2("n")).cast("int"), F.lit(LAST_PARTITION)))
    plans = F.array(*[F.struct(F.lit(hashes_of(p)).alias("hashes"), F.lit(least_hits(hashes_of(p))).alias("hits")) for p in range(LAST_PARTITION + 1)])
    plan = F.get(plans, F.col("partition"))
    small = F.col("n") <= plan["hashes"]
    sizes = sizes.withColumn("need", F.when(small, F.ceil(F.col("n") * CONTAINMENT - 1e-9)).otherwise(plan["hits"]))
    one = shingles.select("item", "shingle").distinct()
    own = one.join(sizes.withColumnRenamed("item", "_item"), one["item"].eqNullSafe(F.col("_item"))).drop("_item")
    whole = own.where(small).select("shingle", "item", F.lit(1).cast("long").alias("slots"))
    hashed = own.where(~small).select("partition", "item", "shingle", F.explode(F.sequence(F.lit(0), plan["hashes"] - 1)).alias("slot"))
    least = hashed.groupBy("partition", "item", "slot").agg(F.min_by("shingle", F.xxhash64("shingle", "slot")).alias("shingle"))
    return whole.union(least.groupBy("shingle", "item").agg(F.count("*").alias("slots")).select("shingle", "item", "slots")), sizes


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", least: float = CONTAINMENT) -> DataFrame:
    """key, item, shared and n_shingles (long), containment: one row for each document and item that it contains."""
    shingles = written(item_shingles(items.select(item, "text"), item), "items")
    slots, sizes = sketch_index(shingles)
    slots, sizes = written(slots, "slots"), written(sizes, "sizes")
    n_slots = slots.count()
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect())  # at most SHINGLE_WORDS values

    rows = docs.select(key, F.xxhash64(text_of()).alias("_text"), words_of(text_of()).alias("w"))
    hashed = F.concat(*[runs(F.col("w"), size, F.xxhash64) for size in lengths]) if lengths else F.array().cast("array<bigint>")
    probes = rows.select(key, "_text", F.explode(hashed).alias("shingle"))
    probes = probes if n_slots <= BROADCAST_ROWS else possible(probes, "shingle", slots)
    hits = probes.join(maybe_broadcast(slots, n_slots), "shingle").groupBy(key, "_text", "item", "shingle").agg(F.first("slots").alias("slots"))
    summed = hits.groupBy(key, "_text", "item").agg(F.sum("slots").alias("hit"))
    counted = summed.join(maybe_broadcast(sizes.withColumnRenamed("item", "_item"), n_slots), summed["item"].eqNullSafe(F.col("_item"))).drop("_item")
    candidates = written(counted.where("hit >= need").select(key, "_text", "item", "n"), "candidates")

    wanted = candidates.select(key, "_text").distinct()
    found = docs.select(key, F.xxhash64(text_of()).alias("_text"), text_of().alias("text"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    same = [F.col("d." + key).eqNullSafe(F.col("w." + key)), F.col("d._text") == F.col("w._text")]
    texts = found.alias("d").join(wanted.alias("w"), same, "left_semi").dropDuplicates([key, "_text"]).select(key, "_text", words_of(F.col("text")).alias("w"))
    said = [runs(F.col("w"), size, lambda r: F.array_join(r, " ")) for size in lengths] or [F.array().cast("array<string>")]
    spoken = texts.select(key, "_text", F.explode(F.array_distinct(F.concat(*said))).alias("words"))
    shared = spoken.join(maybe_broadcast(shingles.select("item", "words"), n_slots), "words").groupBy(key, "_text", "item").agg(F.count("*").alias("shared"))
    pairs = candidates.alias("c").join(
        shared.alias("s"), [F.col("c." + key).eqNullSafe(F.col("s." + key)), F.col("c._text") == F.col("s._text"), F.col("c.item").eqNullSafe(F.col("s.item"))]
    )
    out = pairs.select("c." + key, "c._text", F.col("c.item").alias(item), "shared", F.col("n").alias("n_shingles"), (F.col("shared") / F.col("n")).alias("containment"))
    return out.where(F.col("containment") >= least)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contained_items(docs.select("doc_id", "text"), items).select("doc_id", "item_id", "shared", "n_shingles", F.round("containment", 6).alias("containment"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain no benchmark item."""
    leaks = contained_items(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "_text").distinct()
    leaks = written(leaks, "leaks")
    same = [F.col("k.doc_id").eqNullSafe(F.col("l.doc_id")), F.xxhash64(F.coalesce("k.text", F.lit(""))) == F.col("l._text")]
    return docs.alias("k").join(maybe_broadcast(leaks, leaks.count()).alias("l"), same, "left_anti")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b
), sized AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
lengths AS (SELECT DISTINCT len(string_split(s, ' ')) AS k FROM items),
runs AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM w, lengths
), hit AS (
  SELECT doc_id, item_id, count(*) AS shared FROM runs JOIN items USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, shared, n AS n_shingles, round(shared / n, 6) AS containment
FROM hit JOIN sized USING (item_id) WHERE shared / n >= 0.8
"""
