"""A stored table with keys that batches change: of each batch all is seen or nothing, and a batch that is repeated changes
nothing.

    rows/version=V/slice=S      the rows of a slice (a hash of the key) as version V left them
    versions/V                  the version that each slice has, and the last batch

A batch reads and writes anew only the slices of the keys that it changes. One writer at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.sources.stored import delete_below, latest_state, publish

SLICES = 64


def _rows(spark: SparkSession, path: str, state: dict, only: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    places = T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("slice", T.IntegerType())])
    by_version: dict[int, list[int]] = {}
    for piece, version in state["slices"].items():
        if only is None or int(piece) in only:
            by_version.setdefault(version, []).append(int(piece))
    if not by_version:
        return spark.createDataFrame([], places)
    held = reduce(or_, [(F.col("version") == v) & F.col("slice").isin(pieces) for v, pieces in by_version.items()])
    return spark.read.schema(places).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/version={v}" for v in by_version]).where(held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version."""
    state = latest_state(spark, path)
    if state is None:
        raise ValueError(f"nothing has been written to {path}")
    return _rows(spark, path, state).drop("version", "slice")


def _slices(changed: DataFrame, keys: list[str]) -> DataFrame:
    return changed.select(*keys).distinct().withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(SLICES)).cast("int"))


def _touched(changed: DataFrame) -> list[int]:
    return sorted(r[0] for r in changed.select("slice").distinct().collect())  # SLICES at most


def read_slices(spark: SparkSession, path: str, changed: DataFrame, keys: list[str]) -> DataFrame | None:
    """The rows of the newest version in the slices of the keys in `changed`; None before the first version."""
    state = latest_state(spark, path)
    return None if state is None else _rows(spark, path, state, _touched(_slices(changed, keys))).drop("version", "slice")


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], changed: DataFrame, batch: int) -> None:
    """Puts rows in place of all rows whose keys are in `changed` (keys; those of rows and of what is deleted)."""
    state = latest_state(spark, path) or {"batch": -1, "version": 0, "slices": {}, "schema": rows.schema.jsonValue()}
    if batch <= state["batch"]:
        return
    version, piece = state["version"] + 1, F.pmod(F.xxhash64(*keys), F.lit(SLICES)).cast("int")
    changed = _slices(changed, keys)
    touched = _touched(changed)
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    kept = _rows(spark, path, state, touched).drop("version").alias("o").join(changed.alias("c"), [F.col("o.slice") == F.col("c.slice"), *same], "left_anti")
    both = rows.withColumn("slice", piece).unionByName(kept)
    both.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/rows/version={version}")
    publish(spark, path, version, state | {"batch": batch, "version": version, "slices": state["slices"] | {str(s): version for s in touched}})


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes what only earlier versions read."""
    state = latest_state(spark, path)
    if state is not None:
        live = {f"version={v}" for v in state["slices"].values()}
        delete_below(spark, f"{path}/rows", lambda name: name in live)
        delete_below(spark, f"{path}/versions", lambda name: name >= f"{state['version']:012d}")
