"""Parquet, catalog and JDBC tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from visitgrain.schema import (
    EVENT_TIME,
    PARTITION_MONTH,
    PARTITION_YEAR,
    PARTITIONS,
    STORED_SCHEMA,
    VISIT_SCHEMA,
)
from visitgrain.session import finer_shuffles
from visitgrain.sources.fs import read_bytes
from visitgrain.sources.summary import refresh, remember

ORDER = "no_registrasi"


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error", by: Sequence[str] = ()) -> None:
    df.write.partitionBy(*by).parquet(path, mode=mode)


def with_partitions(df: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    return df.withColumns({PARTITION_YEAR: F.year(ts), PARTITION_MONTH: F.month(ts)})


def write_visits(df: DataFrame, path: str, mode: str = "append", summarise: bool = True) -> None:
    """Write visits partitioned by year and month of the event time, and bring the summary up to it.

    The rebalance sends each month to few writers, splitting a month that is much larger than
    the others; sorting inside a writer gives tight row-group statistics on the event time. Rows
    of one registration lie together, which compresses better here and in later shuffles.
    """
    dealt = with_partitions(df.select(*VISIT_SCHEMA.names)).hint("rebalance", *PARTITIONS)
    with finer_shuffles(df.sparkSession, read_bytes(df)):
        write_dealt(dealt, path, mode, summarise)


def write_dealt(df: DataFrame, path: str, mode: str = "error", summarise: bool = True) -> None:
    """``write_visits`` of rows that have the partition columns and lie by them already."""
    (
        df.select(*STORED_SCHEMA.names)
        .sortWithinPartitions(*PARTITIONS, EVENT_TIME, ORDER)
        .write.partitionBy(*PARTITIONS)
        .option("partitionOverwriteMode", "static")
        .parquet(path, mode=mode)
    )
    if summarise:
        refresh(df.sparkSession, path)


def read_stored_visits(spark: SparkSession, path: str) -> DataFrame:
    return remember(read_parquet(spark, path, STORED_SCHEMA), path)


def create_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType = VISIT_SCHEMA,
    by: Sequence[str] = (),
    path: str | None = None,
) -> None:
    """An empty catalog table with the declared schema."""
    writer = spark.createDataFrame([], schema).write.format("parquet").partitionBy(*by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def has_rows(spark: SparkSession, table: str) -> bool:
    """True when the catalog table exists and holds at least one row."""
    return spark.catalog.tableExists(table) and not spark.table(table).isEmpty()


def append_table(df: DataFrame, table: str) -> None:
    df.write.format("parquet").mode("append").saveAsTable(table)


def query(
    spark: SparkSession, sql: str, parameters: Mapping[str, Any] | None = None, **frames: DataFrame
) -> DataFrame:
    """SQL with bound parameters (``:name``) over catalog tables or frames named ``{name}``."""
    return spark.sql(sql, args=dict(parameters or {}), **frames)


def jdbc_read_options(
    url: str,
    table: str | None = None,
    sql: str | None = None,
    *,
    partition_column: str | None = None,
    lower: Any = None,
    upper: Any = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    if (table is None) == (sql is None):
        raise ValueError("give either table or sql")
    split = (partition_column, lower, upper, partitions)
    if any(x is not None for x in split) and any(x is None for x in split):
        raise ValueError("partition_column, lower, upper and partitions go together")
    given = {
        "url": url,
        # A partitioned read needs dbtable, which takes a query as a derived table.
        "dbtable": table if sql is None else f"({sql}) q",
        "fetchsize": fetch_size,
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": partitions,
    }
    return {k: str(v) for k, v in given.items() if v is not None}


def read_jdbc(
    spark: SparkSession, url: str, table: str | None = None, sql: str | None = None,
    options: Mapping[str, str] | None = None, **split: Any,
) -> DataFrame:
    """A database table or query.

    With ``partition_column``, ``lower``, ``upper`` and ``partitions`` each task reads a range of
    its own; without them one task reads everything, which only suits small tables.
    """
    given = jdbc_read_options(url, table, sql, **split)
    return spark.read.format("jdbc").options(**{**(options or {}), **given}).load()


def write_jdbc(
    df: DataFrame, url: str, table: str, *, mode: str = "append", batch_size: int = 10_000,
    connections: int = 16, options: Mapping[str, str] | None = None,
) -> None:
    """Append rows to a database table over at most ``connections`` connections."""
    given = {"url": url, "dbtable": table, "batchsize": str(batch_size), "numPartitions": str(connections)}
    df.write.format("jdbc").options(**{**(options or {}), **given}).mode(mode).save()
