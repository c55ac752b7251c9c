"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackroom.sources.stored import shared_path  # noqa: F401  for the modules of queries
from stackroom.sources.tables import VIEW_SQL, VIEWS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """t.documento, t.lineitem, ...: views and raw tables of one folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return VIEWS[name](self.spark, self.folder) if name in VIEWS else table(self.spark, self.folder, name)


_PREPARED: dict[tuple[str, str, str], object] = {}


def prepared(t: Tables, name: str, make: Callable[[], object]):
    """What queries share, such as a stored index: made at its first use in an application, for each folder of tables."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _PREPARED:
        _PREPARED[key] = make()
    return _PREPARED[key]


def with_views(sql: str) -> str:
    """sql with the views that it names in front."""
    named = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    views = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in named)
    if not views:
        return sql
    body = sql.strip()
    return f"WITH {views}{',' + body[4:] if body.upper().startswith('WITH ') else ' ' + body}"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name; sql, if given, is its equivalent over views and raw tables."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return build

    return register
