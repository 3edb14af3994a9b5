"""Where query modules put their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Tables whose rows are texts, and the size up to which a few files of them are dealt out to all cores.
TEXT_TABLES, SMALL_BYTES = {"documents", "pages", "conversations"}, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table.

    A row group is read by one task, so a small file of texts would keep one core busy with all that follows; it is dealt
    out first, which moves 64 MB at most. Larger tables are worked on where they are read.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes from fewer files than there are cores and is small, else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_BYTES else df


def query(sql: str | None = None):
    """Register a function under its own name, with its DuckDB SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add
