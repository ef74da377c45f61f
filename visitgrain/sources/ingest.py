"""Batch ingestion: bulk load, upload into an existing table, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.operators.clean import after_dedupe, before_dedupe, clean, convert_types, drop_known, is_typed, project
from visitgrain.operators.filters import from_time, latest_frame
from visitgrain.operators.reshape import union_rows
from visitgrain.schema import EVENT_TIME, VISIT_KEY, VISIT_SCHEMA
from visitgrain.session import finer_shuffles
from visitgrain.sources.files import CORRUPT, read_dataset
from visitgrain.sources.fs import delete, is_written, read_bytes
from visitgrain.sources.staged import drop_known_staged, stage_text, write_once
from visitgrain.sources.tables import read_stored_visits, write_visits


def ingest_batch(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    mode: str = "strict",
    kind: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read, project, cast, clean and append to the partitioned visits table at ``target``.

    Records whose key the table already holds are left out, so a load that is run again adds
    nothing. A record without its key or its time is refused in strict mode and dropped in
    permissive mode, like one that could not be read.
    """
    raw = read_dataset(spark, source, kind=kind, multi_line=multi_line, mode=mode) if isinstance(source, str) else source
    if CORRUPT in raw.columns:
        raw = raw.filter(F.col(CORRUPT).isNull())
    rows = before_dedupe(raw, mode)
    if mode == "strict":
        rows = with_identity(rows)
    with _beside(spark, target) as staged:
        rows = stage_text(rows, f"{staged}/rows", is_typed(raw))
        if is_written(spark, target):
            rows = drop_known_staged(rows, read_stored_visits(spark, target), f"{staged}/known")
        write_once(rows, target, staged, "append", True, lambda kept: with_identity(after_dedupe(kept), mode))
    return read_stored_visits(spark, target)


@contextmanager
def _beside(spark: SparkSession, target: str) -> Iterator[str]:
    """A folder for what a load stages, not among the table's files, which goes with the load."""
    staged = f"{target.rstrip('/')}-staged-{uuid.uuid4().hex[:12]}"
    try:
        yield staged
    finally:
        delete(spark, staged)


def with_identity(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """Rows that have a key and an event time; in strict mode one without them fails the job."""
    whole = F.col(VISIT_KEY).isNotNull() & F.col(EVENT_TIME).isNotNull()
    if mode == "permissive":
        return rows.filter(whole)
    failure = F.raise_error(F.lit(f"a record lacks {VISIT_KEY} or {EVENT_TIME}"))
    return rows.filter(F.when(whole, True).otherwise(failure.cast("boolean")))


def merge_upload(
    spark: SparkSession, current: str, upload: str | DataFrame, target: str
) -> DataFrame:
    """Old and uploaded rows cleaned together and written to ``target``.

    ``target`` is a new path: a table cannot be overwritten while it is being read, and readers
    of ``current`` keep a whole table until they switch.
    """
    if current.rstrip("/") == target.rstrip("/"):
        raise ValueError("target must differ from current")
    new = read_dataset(spark, upload) if isinstance(upload, str) else upload
    old = read_stored_visits(spark, current).select(*VISIT_SCHEMA.names)
    both = union_rows(old, convert_types(project(new)))
    with _beside(spark, target) as staged:
        rows = stage_text(before_dedupe(both), f"{staged}/rows", is_typed(new))
        write_once(rows, target, staged, summarise=True)
    return read_stored_visits(spark, target)


def append_upload(spark: SparkSession, current: str, upload: str | DataFrame) -> DataFrame:
    """Clean only the upload, drop what the table already holds, and append the rest.

    The table's own rows are clean and unique already, so the result has the same keys as
    ``merge_upload`` without rewriting the table; where a key repeats, the stored row stays.
    """
    new = clean(read_dataset(spark, upload) if isinstance(upload, str) else upload)
    new = with_identity(new).persist()  # both sides of drop_known read it
    try:
        write_visits(drop_known(new, read_stored_visits(spark, current)), current, mode="append")
    finally:
        new.unpersist()
    return read_stored_visits(spark, current)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The Parquet snapshot at ``path``, built and written first if it is not there."""
    if not is_written(spark, path):
        built = build()
        with finer_shuffles(spark, read_bytes(built)):
            built.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newer_than_table(source: DataFrame, table: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    """Source rows later than the table's latest event time; all rows while it is empty."""
    mark = latest_frame(table, ts).select(
        F.coalesce("latest", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t")
    )
    return from_time(source, ts, mark.scalar(), included=False)
