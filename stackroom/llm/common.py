"""What the training-data operators share: table access, written intermediate tables, and distributed running sums."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes of text that one Arrow batch carries to a Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20

#: A lookup side is broadcast up to this many rows, which its builder counts first; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: The same for a single column of 64-bit keys: at most some 90 MB as a hashed relation.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a single machine (tests) gets one of
    our own; a cluster is refused, as its executors would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stackroom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for what is run inside; afterwards those from before hold again."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Tables known to have at most so many rows are written as a few files.
FEW_ROWS, FEW_FILES = 1_000_000, 12


def written(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """df, computed once and read back from the shared folder: later steps survive the loss of any executor. What its
    shuffles left on the executors' disks is not needed any more and goes at once. most_rows: a bound on its rows."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df = df.coalesce(FEW_FILES) if most_rows is not None and most_rows <= FEW_ROWS else df
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def python_path(spark: SparkSession) -> None:
    """To call before Python tasks are planned: lets workers import this package from where the driver has it."""
    known, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), here]))


def python_tasks(spark: SparkSession) -> None:
    """python_path, and a bound to what an Arrow batch of whole texts holds, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    python_path(spark)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df as a broadcast side if its counted rows allow it; else Spark chooses a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Bits of the filter below: 16 MB, whatever it is made of.
FILTER_BITS = 1 << 27


def possible(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows of df whose key may be among known's (of the same name): all that are, and few others as long as known has
    fewer keys than FILTER_BITS. The filter has a fixed size and is broadcast, so that df's rows don't move for it."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = known.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    # A bucket's bytes become longs once, so that a row's look-up is one element and one bit. A long's first byte is its
    # highest.
    word = lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = bits.select("_bucket", F.transform(F.sequence(F.lit(0), (F.length("_bits") / 8).cast("int") - 1), word).alias("_words"))
    placed = df.withColumn("_at", F.bitmap_bit_position(place).cast("int")).withColumn("_bucket", F.bitmap_bucket_number(place))
    at = F.col("_at")
    found = F.getbit(F.get("_words", F.shiftright(at, 6)), F.lit(56) - at.bitwiseAND(56) + at.bitwiseAND(7))
    return placed.join(F.broadcast(words), "_bucket").where(found == 1).drop("_at", "_bucket", "_words")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, everything else left as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_sum(df: DataFrame, group: list[str], key: str, value: Column, out: str, ties: list[str] = (), bits: int = 12) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same group that come earlier by (key, ties).

    key is a 64-bit hash column. Rows are cut into 2**bits ranges of it; only the ranges' sums pass a window per
    group, and each range is then summed on its own, so that one group holding most rows is still spread out.
    group columns must not be null.
    """
    ranged = df.withColumn("_range", F.shiftrightunsigned(F.col(key), 64 - bits)).withColumn("_value", value)
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
    starts = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(starts, [*group, "_range"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_range", "_value", "_start")
    )
