"""Loading tables and registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graph import settle

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rows read in fewer pieces than there are cores are dealt over the cores, ahead of costly expressions; else as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def register(queries: dict[str, Query], oracle: dict[str, str], sql: str | None = None):
    """Add a query under its function's name, and its SQL."""

    def add(f: Query) -> Query:
        queries[f.__name__] = f
        if sql:
            oracle[f.__name__] = sql
        return f

    return add


def once(df: DataFrame) -> DataFrame:
    """What several branches of a query read is computed once, in the shared folder where there is one."""
    return settle(df)
