"""Text file sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from visitgrain.schema import COLUMNS, TEXT_SCHEMA

#: Text of a record that could not be read, in permissive mode.
CORRUPT = "_corrupt"


def json_options(mode: str, schema: T.StructType, columns: Sequence[str] | None = None) -> tuple[dict, T.StructType]:
    """Reader options and schema for a mode.

    ``"strict"``: text that is no JSON, or no record of the schema, fails the read. ``"permissive"``:
    it becomes a row of nulls with its text in ``_corrupt``, never a row that looks like data.
    """
    if mode == "strict":
        return {"mode": "FAILFAST"}, schema
    if mode != "permissive":
        raise ValueError(f"mode must be 'strict' or 'permissive', not {mode!r}")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return options, T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def header_schema(spark: SparkSession, path: str) -> T.StructType:
    """All columns of a CSV as text, in file order; reads the header line only."""
    return spark.read.option("header", True).csv(path).schema


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = tuple(COLUMNS),
    partitions: int | None = None,
) -> DataFrame:
    """Named columns of a CSV with a header, as text; ``.csv.gz`` works the same.

    A gzip file cannot be split: pass ``partitions`` to spread the rows of few files over so many
    tasks before further work, and land them as Parquet. Files that make as many tasks stay where they are.
    """
    df = (
        spark.read.schema(header_schema(spark, path))
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
        .select(*columns)
    )
    return df.repartition(partitions) if partitions and df.rdd.getNumPartitions() < partitions else df


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType = TEXT_SCHEMA,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
    mode: str = "strict",
) -> DataFrame:
    """Record objects, one per line or in arrays of one line each.

    ``multi_line`` is for arrays spread over several lines; such a file is read by one task. In
    permissive mode the frame has the column ``_corrupt`` too, null for good records.
    """
    options, full = json_options(mode, schema)
    df = spark.read.schema(full).options(**options).option("multiLine", multi_line).json(path)
    if not columns:
        return df
    return df.select(*columns, *([CORRUPT] if mode == "permissive" else []))


def corrupt_records(df: DataFrame) -> DataFrame:
    """The rows that a permissive read could not parse."""
    return df.filter(F.col(CORRUPT).isNotNull())


def read_dataset(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = tuple(COLUMNS),
    kind: str | None = None,
    multi_line: bool = False,
    mode: str = "strict",
) -> DataFrame:
    """Reader chosen by ``kind``, or by extension: csv (plain or gzip), json or parquet.

    ``multi_line`` and ``mode`` are for JSON.
    """
    if kind is None:
        name = path.rstrip("/").lower().removesuffix(".gz")
        kind = name.rsplit(".", 1)[-1]
    if kind == "csv":
        return read_csv(spark, path, columns)
    if kind == "json":
        return read_json(spark, path, columns=columns, multi_line=multi_line, mode=mode)
    if kind == "parquet":
        return spark.read.parquet(path).select(*columns)
    raise ValueError(f"Unsupported source: {path}")
