"""A register of queries: name -> (function of spark and folder, SQL that gives the same rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t.orders and so on: the tables of a folder; timestamps without zone become UTC timestamps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def query(name: str, sql: str | None = None):
    """Register build(t) under a name; t: Tables."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])
