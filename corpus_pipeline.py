"""From raw documents to shards of a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and is written as Parquet before
the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackroom.llm import decontamination, mixing, near_dedup, quality, sharding
from stackroom.llm.common import table, written

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing sources to target weights", mixing.stage),
    ("sharding", sharding.stage),
]

#: A trained classifier and weighted sampling decide which documents stay: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
