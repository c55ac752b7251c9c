"""A stored vector index: inverted lists on disk with product-quantised codes, for approximate nearest rows by cosine.

    model/                      centres of the lists, and the codes' centres in each slice of the dimensions
    vectors/batch=N/list=L      key, vector, lists, code: each row once, in the list of its nearest centre
    codes/batch=N/list=L        key, home, code: each row in the lists of its COPIES nearest centres

The model is fitted on at most SAMPLE_ROWS rows (lowest by a hash of the vector); every row is indexed. Rows that come later
are put into lists by the same model; a batch that is written again replaces what it wrote. A search ranks the rows of the
lists nearest to a query by their codes, which are a fraction of a vector, and the best of these by their vectors.

Rows without a vector, with a null in it or of another dimension than the model's are not indexed, and such queries find
nothing. A zero vector has distance 1 to all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.sources.stored import python_path

LISTS, COPIES, PROBES = 100, 3, 20
#: Slices of the dimensions, and codes of each.
SLICES, CODES = 16, 256
SAMPLE_ROWS, ROUNDS, SEED = 20_000, 12, 11
#: Tasks among which the rows of a list are dealt.
DEALT = 4
#: Queries and rows whose sums over codes a task holds at once.
QUERY_STEP, ROW_STEP = 64, 4096


@dataclass(frozen=True)
class Model:
    centres: np.ndarray  # list, dimension
    codebooks: np.ndarray  # slice, code, dimensions of a slice

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (row, slice, dimensions of a slice), with zeros behind the last dimension."""
        wide = self.codebooks.shape[0] * self.codebooks.shape[2]
        return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), self.codebooks.shape[0], -1)

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.codebooks)), np.uint8)
        for i, book in enumerate(self.codebooks):
            out[:, i] = ((book**2).sum(1)[None, :] - 2 * self.padded(x)[:, i] @ book.T).argmin(1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _means(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres of a bounded sample; fewer rows than n give repeated centres."""
    centres = x[rng.permutation(len(x))[np.arange(n) % len(x)]].copy()
    for _ in range(ROUNDS):
        at = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(at, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _usable(rows: DataFrame, vector: str, dimension: int | None = None) -> DataFrame:
    held = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & (F.size(vector) > 0)
    return rows.where(held if dimension is None else held & (F.size(vector) == dimension))


def fit(rows: DataFrame, vector: str, lists: int = LISTS, slices: int = SLICES) -> Model:
    """A model from a bounded sample, of the dimension that most rows have."""
    rows = _usable(rows, vector)
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        raise ValueError("no vectors to fit an index on")
    sample = rows.where(F.size(vector) == sizes.d).select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).toArrow()
    x = unit(sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, sizes.d))
    rng = np.random.default_rng(SEED)
    width = -(-sizes.d // slices)
    model = Model(_means(x, lists, rng), np.zeros((slices, CODES, width)))
    return Model(model.centres, np.stack([_means(model.padded(x)[:, i], CODES, rng) for i in range(slices)]))


def save_model(spark: SparkSession, path: str, model: Model) -> None:
    spark.createDataFrame([(model.centres.tolist(), model.codebooks.tolist())], "centres array<array<double>>, codebooks array<array<array<double>>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(f"{path}/model").first()
    return Model(np.array(row.centres), np.array(row.codebooks))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def _placed(batches, model, key: str, vector: str, copies: int):
    model = model.value
    for batch in batches:
        x = unit(_matrix(batch.column(vector), model.dimension))
        lists, codes = model.nearest_lists(x, copies).astype(np.int32), model.codes(x)
        columns = [batch.column(key), batch.column(vector), pa.array(lists[:, 0] if len(lists) else [], pa.int32()), pa.array(list(lists), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [key, "vector", "list", "lists", "code"])


def add(spark: SparkSession, path: str, rows: DataFrame, key: str, vector: str, batch: int = 0, copies: int = COPIES) -> None:
    """Rows (key, vector) into the index at path, which has a model."""
    python_path(spark)
    model = load_model(spark, path)
    shared, n = spark.sparkContext.broadcast(model), min(copies, len(model.centres))
    schema = T.StructType([rows.schema[key], T.StructField("vector", rows.schema[vector].dataType), *T.StructType.fromDDL("list int, lists array<int>, code binary").fields])
    placed = _usable(rows, vector, model.dimension).select(key, vector).mapInArrow(lambda batches: _placed(batches, shared, key, vector, n), schema)
    deal = F.pmod(F.xxhash64(key), F.lit(DEALT))
    placed.repartition("list", deal).sortWithinPartitions("list", key).write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors/batch={batch}")
    codes = spark.read.schema(schema).parquet(f"{path}/vectors/batch={batch}").select(key, F.col("list").alias("home"), F.explode("lists").alias("list"), "code")
    codes.repartition("list", deal).sortWithinPartitions("list", key).write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes/batch={batch}")


def create(spark: SparkSession, path: str, rows: DataFrame, key: str, vector: str, lists: int = LISTS, slices: int = SLICES, copies: int = COPIES) -> None:
    save_model(spark, path, fit(rows, vector, lists, slices))
    add(spark, path, rows, key, vector, 0, copies)
