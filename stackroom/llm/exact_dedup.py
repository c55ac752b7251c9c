"""Exact deduplication as a stream over keyed state.

Rows flow as (digest, id, locator) through a Structured Streaming aggregation whose state, without expiry, lies in
RocksDB: for each digest it retains the greatest id, the place its content can be read from, and the number of rows.
Where a digest is hit more than once, the rows' full bytes are compared: they are grouped by them, within each task
first, so that the copies of a hot text are not moved one by one. Rows that differ in spite of their digest are told
apart by their bytes.

Defined cases: a null text counts as empty, and empty texts are equal; very long texts are compared whole; equal means
identical after lower-casing A-Z; of rows with equal text and id one stays, that with the greatest locator; ids are of
any type that can be ordered, and a null id is the least; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.common import BROADCAST_ROWS, ascii_lower, fresh_path, possible, table, text_of, written

#: Files of digests that one micro-batch takes; the stream continues from its checkpoint.
FILES_PER_BATCH = 1000
#: Digests of the first run that one partition of the state is made for. Its checkpoint then holds to that number.
DIGESTS_PER_STORE = 2_000_000

# State on disk; only changes are written to the checkpoint between snapshots, and files take the space they fill.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normal_text() -> Column:
    return ascii_lower(text_of())


def digest_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def state_session(spark: SparkSession, digests: int) -> SparkSession:
    """A session with settings of its own for the stream: those of the caller's stay as they are."""
    own = spark.newSession()
    for name, value in _STATE.items():
        own.conf.set(name, value)
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, least, math.ceil(digests / DIGESTS_PER_STORE))))
    return own


def keep_latest(spark: SparkSession, digests_path: str, schema, checkpoint: str, updates_path: str) -> DataFrame:
    """Runs the stream over what has arrived at digests_path. digest -> best (id, locator), group_size."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{updates_path}/b={number}")

    own = state_session(spark, spark.read.schema(schema).parquet(digests_path).count())
    arrived = own.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(digests_path)
    state = arrived.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("best"), F.count("*").alias("group_size"))
    query = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    updated = f"digest string, best struct<id: {schema['id'].dataType.simpleString()}, locator: string>, group_size bigint, batch int"
    spark.createDataFrame([], updated).write.mode("overwrite").parquet(f"{updates_path}/b=none")
    updates = spark.read.schema(updated).option("recursiveFileLookup", "true").parquet(updates_path)
    return updates.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, text, locator) -> id, keep_id, group_size, kept, digest, one row for every row of docs.

    locator names a row's content uniquely.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), "locator", normal_text().alias("bytes")).select("*", digest_of(F.col("bytes")).alias("digest"))
    path = fresh_path(spark, "digests")
    small = rows.select("id", "digest", "locator")
    small.write.parquet(path)
    digests = spark.read.schema(small.schema).parquet(path)
    state = written(keep_latest(spark, path, small.schema, fresh_path(spark, "stream"), fresh_path(spark, "updates")), "state")

    # Full bytes of the rows that hit a digest: texts of other rows are left out before anything moves.
    hit = written(state.where("group_size > 1").select("digest"), "hit")
    texts = rows.join(F.broadcast(hit), "digest", "left_semi") if hit.count() <= BROADCAST_ROWS else possible(rows, "digest", hit)
    different = texts.groupBy("digest", "bytes").agg(F.count("*").alias("n"))
    collided = written(different.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "collided")

    out = digests.join(state, "digest").select("id", "digest", "locator", "best", "group_size")
    if not collided.isEmpty():
        out = _told_apart(out, rows, collided)
    return out.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("best.locator")).alias("kept"), "digest")


def _told_apart(out: DataFrame, rows: DataFrame, collided: DataFrame) -> DataFrame:
    """out with best and group_size of each text's own rows, where texts share a digest."""
    odd = written(rows.join(collided, "digest"), "odd")
    groups = odd.groupBy("digest", "bytes").agg(F.max(F.struct("id", "locator")).alias("own_best"), F.count("*").alias("own_size"))
    placed = odd.join(groups, ["digest", "bytes"]).select("locator", "own_best", "own_size")
    return out.join(placed, "locator", "left").withColumns({"best": F.coalesce("own_best", "best"), "group_size": F.coalesce("own_size", "group_size")})


def with_locator(df: DataFrame) -> DataFrame:
    """A file's path and the row in it, for a DataFrame read from Parquet files."""
    return df.withColumn("locator", F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_locator(table(spark, sf_dir, "documents")).select("doc_id", "text", "locator")
    return exact_duplicates(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
