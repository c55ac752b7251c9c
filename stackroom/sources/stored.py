"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where the session says that all see it; a temporary one only in local mode, where it says nothing."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stackroom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_path(spark: SparkSession) -> None:
    """To call before Python tasks are planned: lets workers import this package from where the driver has it."""
    known, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), here]))


def folder_of(spark: SparkSession, path: str):
    """(file system, path) of a folder, for what Spark's readers can't do: list it and delete from it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def publish(spark: SparkSession, path: str, version: int, state: dict) -> None:
    """Makes a version of a stored table known to readers: the last thing that is written of it."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/versions/{version:012d}")


def latest_state(spark: SparkSession, path: str) -> dict | None:
    """The newest version that was written to its end; None before the first."""
    files, folder = folder_of(spark, f"{path}/versions")
    listed = files.listStatus(folder) if files.exists(folder) else []
    done = sorted(f.getPath().getName() for f in listed if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    return json.loads(spark.read.text(f"{path}/versions/{done[-1]}").first().value) if done else None


def delete_below(spark: SparkSession, path: str, keep) -> None:
    """Deletes the folders in path whose names keep(name) refuses."""
    files, folder = folder_of(spark, path)
    for f in files.listStatus(folder) if files.exists(folder) else []:
        if not keep(f.getPath().getName()):
            files.delete(f.getPath(), True)


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
