"""Sharding by jump consistent hashing: a stable key and the number of shards alone decide the shard.

The algorithm is that of Lamping and Veach (2014). Appending a shard moves rows only into the new shard, about one
row in n. Nothing is looked up, so that shards need no table and no coordination.

Defined cases: a null key is one key like any other; repeated keys share a shard; an empty table gives an empty
result; further columns pass through untouched unless they carry the names of the columns added here, which then win.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stackroom.llm.common import python_tasks, running_sum, table, text_of

SHARDS = 8

# Fixed values of the published algorithm.
JUMP_MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    target = np.zeros(len(state), np.int64)
    while len(moving):
        at[moving] = target
        state[moving] = state[moving] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        target = ((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        stays = target < shards
        moving, target = moving[stays], target[stays]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a column of any hashable type."""

    @pandas_udf("int")
    def shard(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy().view(np.uint64), shards), dtype="int32")

    return shard(F.xxhash64(key))


def add_shards(df: DataFrame, key: str, shards: int = SHARDS, shard: str = "shard") -> DataFrame:
    python_tasks(df.sparkSession)
    return df.withColumn(shard, shard_of(F.col(key), shards))


def add_slots(df: DataFrame, key: str, ties: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in the order of the key's hash."""
    return running_sum(df.withColumn("_key", F.xxhash64(key)), [shard], "_key", F.lit(1).cast("long"), slot, ties).drop("_key")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    grown = add_shards(add_shards(docs, "doc_id"), "doc_id", SHARDS + 1, "grown_shard")
    return add_slots(grown, "doc_id", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their shard, written together by it."""
    return add_shards(docs, "doc_id")
