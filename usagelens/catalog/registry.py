"""Registered queries with their reference SQL, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is the statement an independent engine runs on the same tables."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(function(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def plain(frame: DataFrame) -> DataFrame:
    """Columns as both engines print them alike: times and arrays as text, integers as 64 bit."""
    out = []
    for name, kind in frame.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            column = column.cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind == "float":
            column = column.cast("double")
        elif kind == "array<string>":
            column = F.array_join(column, ",")
        elif kind.startswith("array<"):
            column = F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
        out.append(column.alias(name))
    return frame.select(*out)
