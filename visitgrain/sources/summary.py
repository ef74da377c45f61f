"""A small table beside a stored visits table: one row per month.

It holds each month's rows, first and last event time, the labels of the columns that have few, and
a digest of the month's files. Questions about the table as a whole (the latest time, the months
and years that have visits, the labels to offer) read it instead of the table's folders. A month
whose files hold no rows is listed with 0 rows and answers nothing.

``refresh`` follows every write: only months whose files have changed are aggregated again, and the
new version is written whole beside the one that readers may still hold. A version is named by a digest of all files
it describes. A reader takes the version of the files it reads itself; where there is none, because
something else wrote to the table, it goes back to the table. So an answer is never older or newer
than the frame it is asked of.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from visitgrain.schema import EVENT_TIME, PARTITION_MONTH, PARTITION_YEAR, PARTITIONS, STORED_SCHEMA
from visitgrain.sources.fs import delete, finished

FOLDER = "_summary"
ROWS, FIRST, LAST, FILES, DIGEST = "rows", "first_time", "last_time", "files", "digest"
#: Columns of few values, whose labels are kept.
LABELS = ("jenis_kelamin", "provinsi", "kabupaten", "rujukan", "jenis_registrasi", "jenis_penjamin", "kategori_usia")
#: Versions that stay, for readers that began before the newest was written.
KEPT_VERSIONS = 2

SUMMARY_SCHEMA = T.StructType(
    [
        *(T.StructField(p, T.IntegerType()) for p in PARTITIONS),
        T.StructField(ROWS, T.LongType()),
        T.StructField(FIRST, T.TimestampNTZType()),
        T.StructField(LAST, T.TimestampNTZType()),
        T.StructField(FILES, T.LongType()),
        T.StructField(DIGEST, T.StringType()),
        *(T.StructField(c, T.ArrayType(T.StringType())) for c in LABELS),
    ]
)

_MONTH = re.compile(rf"/{PARTITION_YEAR}=(-?\d+)/{PARTITION_MONTH}=(\d+)/([^/]+)$")

#: Frames read straight from a stored table; whatever is derived from them is another frame.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _months(frame: DataFrame) -> dict[tuple[int, int], tuple[int, str]] | None:
    """(year, month) -> (number of files, digest of their names); file names are never used twice.

    None where rows without an event time have a folder of their own: no month describes them.
    """
    names: dict[tuple[int, int], list[str]] = {}
    for path in frame.inputFiles():
        found = _MONTH.search(path)
        if not found:
            return None
        names.setdefault((int(found[1]), int(found[2])), []).append(found[3])
    return {k: (len(v), hashlib.sha256("\n".join(sorted(v)).encode()).hexdigest()[:24]) for k, v in names.items()}


def _name(months: dict[tuple[int, int], tuple[int, str]]) -> str:
    return hashlib.sha256(repr(sorted(months.items())).encode()).hexdigest()[:24]


def _versions(spark: SparkSession, path: str) -> list[str]:
    return finished(spark, f"{path}/{FOLDER}/*")


def _read(spark: SparkSession, version: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).parquet(version)


def _labels(column: str) -> Column:
    """The distinct values, null first if a row lacks one."""
    none = F.when(F.bool_or(F.col(column).isNull()), F.array(F.lit(None).cast("string")))
    return F.concat(F.coalesce(none, F.array().cast("array<string>")), F.array_sort(F.collect_set(column)))


def refresh(spark: SparkSession, path: str) -> None:
    """Bring the summary of the table at ``path`` up to its files."""
    table = spark.read.schema(STORED_SCHEMA).parquet(path)
    months = _months(table)
    if months is None:
        return
    versions = _versions(spark, path)
    known = {(r[0], r[1]): r for r in _read(spark, versions[-1]).collect()} if versions else {}
    same = [tuple(r) for k, r in known.items() if k in months and r[DIGEST] == months[k][1]]
    changed = [k for k in months if k not in known or known[k][DIGEST] != months[k][1]]
    if any(_name(months) in v for v in versions):
        return
    files = spark.createDataFrame(
        [(*k, *months[k]) for k in changed], f"{PARTITION_YEAR} int, {PARTITION_MONTH} int, {FILES} bigint, {DIGEST} string"
    )
    years = sorted({y for y, _ in changed})
    number = F.col(PARTITION_YEAR) * 12 + F.col(PARTITION_MONTH)
    touched = table.where(F.col(PARTITION_YEAR).isin(years) & number.isin([y * 12 + m for y, m in changed]))
    made = touched.groupBy(*PARTITIONS).agg(
        F.count("*").alias(ROWS),
        F.min(EVENT_TIME).alias(FIRST),
        F.max(EVENT_TIME).alias(LAST),
        *(_labels(c).alias(c) for c in LABELS),
    )
    fresh = files.join(made, list(PARTITIONS), "left").withColumn(ROWS, F.coalesce(ROWS, F.lit(0)))
    whole = fresh.select(*SUMMARY_SCHEMA.names).unionByName(spark.createDataFrame(same, SUMMARY_SCHEMA))
    number = int(versions[-1].rsplit("/v", 1)[1][:8]) + 1 if versions else 1
    whole.coalesce(1).write.parquet(f"{path}/{FOLDER}/v{number:08d}-{_name(months)}-{uuid.uuid4().hex[:8]}")
    for old in versions[: 1 - KEPT_VERSIONS]:
        delete(spark, old)


def remember(frame: DataFrame, path: str) -> DataFrame:
    """Mark a frame as all rows of the stored table at ``path``."""
    _stored[frame] = path
    return frame


def stored_path(frame: DataFrame) -> str | None:
    """Where the table lies whose rows the frame is; None for a frame that is derived from one."""
    return _stored.get(frame)


def months_of(frame: DataFrame) -> dict[tuple[int, int], tuple[int, str]] | None:
    """(year, month) -> (files, their digest) of a frame that is a whole stored table."""
    return _months(frame) if frame in _stored else None


def summary_of(frame: DataFrame) -> DataFrame | None:
    """The months of a frame that is a whole stored table, from its summary; None for any other
    frame, and where the summary doesn't describe the frame's files."""
    path = _stored.get(frame)
    if path is None:
        return None
    spark, months = frame.sparkSession, _months(frame)
    version = next((v for v in _versions(spark, path) if months is not None and _name(months) in v), None)
    return None if version is None else _read(spark, version).where(F.col(ROWS) > 0)


def labels_of(frame: DataFrame, column: str) -> DataFrame | None:
    """The distinct values of a column of a whole stored table, null included, if its summary keeps them."""
    table = summary_of(frame) if column in LABELS else None
    return None if table is None else table.select(F.explode(column).alias(column)).distinct()

