"""Registry of named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


SPREAD = "docketflow.spread"
#: Most rows of a task of a dealt table, and rows for which another task is worth while.
ROWS_OF_A_TASK, FEW_ROWS = 2_048, 64


def read_spread(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table whose rows are costly to process.

    It is read as it is stored.  Who keeps a table in one small file sets
    ``docketflow.spread`` to the number of parts its rows are to be dealt to.
    """
    df = read(spark, folder, table)
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df


def read_dealt(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table whose every row is work of milliseconds, dealt to tasks by its number of rows.

    Its files are small for that work and may be uneven, so they say nothing about the tasks it
    needs: all cores get some, and no task has more than ``ROWS_OF_A_TASK`` rows however large
    the table is.  ``docketflow.spread`` sets another number of parts.
    """
    return deal(read(spark, folder, table))


def deal(df: DataFrame) -> DataFrame:
    """A written table dealt to tasks by its number of rows, as ``read_dealt`` says."""
    spark = df.sparkSession
    parts = spark.conf.get(SPREAD, None)
    if parts:
        return df.repartition(int(parts))
    rows = df.count()
    few = min(spark.sparkContext.defaultParallelism, -(-rows // FEW_ROWS))
    return df.repartition(max(few, -(-rows // ROWS_OF_A_TASK), 1))
