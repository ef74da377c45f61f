"""A stored visits table whose content is replaced while it is being read.

Rows lie in editions: ``data/edition=<name>/visit_year=…/visit_month=…``, each written once and never
changed. A version is a small list of the month folders that make up the table, and it counts once its
own write has finished, which is the last step of every change. A reader takes the newest version and
keeps it: whatever an upload, a compaction or a broken attempt does meanwhile, it sees one version whole.

``append`` adds an edition, ``upload`` merges records by key and rewrites the months they touch,
``compact`` gives months of many editions one, ``expire`` removes what only old versions name. One
writer at a time; readers need no agreement. Every row has a key and an event time. A load of no rows
makes a version with the same months; a table without a version is read as empty.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from visitgrain.operators.clean import before_dedupe, clean, dedupe_by_key, drop_known
from visitgrain.schema import PARTITION_MONTH, PARTITION_YEAR, PARTITIONS, STORED_SCHEMA, VISIT_KEY, VISIT_SCHEMA
from visitgrain.sources.fs import delete, finished, hadoop_path
from visitgrain.sources.files import read_dataset
from visitgrain.sources.ingest import with_identity
from visitgrain.sources.staged import drop_known_staged, stage, write_once
from visitgrain.sources.tables import write_visits
from visitgrain.streaming.landing import start

EDITION = "edition"
KEPT_VERSIONS = 2
_LIST = T.StructType(
    [
        *(T.StructField(p, T.IntegerType()) for p in PARTITIONS),
        T.StructField(EDITION, T.StringType()),
        T.StructField("last_batch", T.LongType()),
    ]
)
_MONTH = re.compile(rf"/{EDITION}=([^/]+)/{PARTITION_YEAR}=(-?\d+)/{PARTITION_MONTH}=(\d+)$")


class Place(NamedTuple):
    """One month of one edition."""

    year: int
    month: int
    edition: str


class Version(NamedTuple):
    number: int
    places: frozenset[Place]
    last_batch: int


def _lists(spark: SparkSession, table: str) -> list[str]:
    return finished(spark, f"{table}/versions/v*")


def _read_list(spark: SparkSession, path: str) -> Version:
    rows = spark.read.schema(_LIST).parquet(path).collect()  # a row per month and edition
    places = frozenset(Place(*r[:3]) for r in rows if r[EDITION] is not None)
    return Version(int(path.rsplit("/v", 1)[1][:8]), places, max((r["last_batch"] for r in rows), default=-1))


def newest(spark: SparkSession, table: str) -> Version:
    found = _lists(spark, table)
    return _read_list(spark, found[-1]) if found else Version(0, frozenset(), -1)


def read(spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
    """The table as of a version, by default the newest; filters on time prune its months."""
    version = version or newest(spark, table)
    if not version.places:
        return spark.createDataFrame([], STORED_SCHEMA)
    root = f"{table}/data"
    paths = [f"{root}/{EDITION}={p.edition}/{PARTITION_YEAR}={p.year}/{PARTITION_MONTH}={p.month}" for p in sorted(version.places)]
    schema = T.StructType([*STORED_SCHEMA.fields, T.StructField(EDITION, T.StringType())])
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).drop(EDITION)


def _folders(spark: SparkSession, table: str, edition: str = "*") -> set[Place]:
    """Month folders that lie under the table, listed or not."""
    pattern = f"{table}/data/{EDITION}={edition}/{PARTITION_YEAR}=*/{PARTITION_MONTH}=*"
    jpath, fs = hadoop_path(spark, pattern)
    found = [_MONTH.search(s.getPath().toString()) for s in fs.globStatus(jpath) or []]
    return {Place(int(m[2]), int(m[3]), m[1]) for m in found if m}


def _in(months: set[tuple[int, int]]) -> Column:
    """Rows of some months; names partitions only."""
    if not months:
        return F.lit(False)
    number = F.col(PARTITION_YEAR) * 12 + F.col(PARTITION_MONTH)
    years = sorted({y for y, _ in months})
    return F.col(PARTITION_YEAR).isin(years) & number.isin(sorted(y * 12 + m for y, m in months))


def _publish(
    rows: DataFrame, table: str, old: Version, replaced: set[tuple[int, int]], last_batch: int | None = None,
    write: Callable[[DataFrame, str], None] | None = None,
) -> Version:
    """Write ``rows`` as an edition and list it instead of all there was of the months ``replaced``."""
    spark, number = rows.sparkSession, old.number + 1
    edition = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    path = f"{table}/data/{EDITION}={edition}"
    if write:
        write(rows, path)
    else:
        write_visits(rows, path, mode="error", summarise=False)
    kept = {p for p in old.places if (p.year, p.month) not in replaced}
    new = Version(number, frozenset(kept | _folders(spark, table, edition)), old.last_batch if last_batch is None else last_batch)
    entries = [(*p, new.last_batch) for p in sorted(new.places)] + [(None, None, None, new.last_batch)]
    listing = spark.createDataFrame(entries, _LIST)
    listing.coalesce(1).write.parquet(f"{table}/versions/v{number:08d}-{uuid.uuid4().hex[:8]}")
    return new


def append(rows: DataFrame, table: str) -> Version:
    """Add clean visits whose keys the table does not hold; others are left out."""
    old = newest(rows.sparkSession, table)
    fresh = drop_known(with_identity(rows.select(*VISIT_SCHEMA.names)), read(rows.sparkSession, table, old))
    return _publish(fresh, table, old, set())


def upload(spark: SparkSession, table: str, source: str | DataFrame) -> Version:
    """Clean records and merge them in: of a key's rows the least stays, as in ``dedupe_by_key``.

    Months that get records, and those holding a row of their keys, are written anew; no others
    are read beyond their keys.
    """
    old = newest(spark, table)
    raw = read_dataset(spark, source) if isinstance(source, str) else source
    staged = f"{table}/staged/{uuid.uuid4().hex[:12]}"
    write_visits(with_identity(clean(raw)), staged, summarise=False)
    new = spark.read.schema(STORED_SCHEMA).parquet(staged)
    stored = read(spark, table, old)
    held = stored.select(VISIT_KEY, *PARTITIONS).join(new.select(VISIT_KEY), VISIT_KEY, "left_semi")
    touched = {tuple(r) for f in (new, held) for r in f.select(*PARTITIONS).distinct().collect()}  # months
    both = stored.where(_in(touched)).unionByName(new).select(*VISIT_SCHEMA.names)
    made = _publish(dedupe_by_key(both), table, old, touched)
    delete(spark, staged)
    return made


def compact(spark: SparkSession, table: str, most: int = 1) -> Version:
    """Give every month that lies in more than ``most`` editions a single one; rows stay the same."""
    old = newest(spark, table)
    months = [(p.year, p.month) for p in old.places]
    many = {m for m in set(months) if months.count(m) > most}
    if not many:
        return old
    return _publish(read(spark, table, old).where(_in(many)), table, old, many)


def expire(spark: SparkSession, table: str, keep: int = KEPT_VERSIONS) -> None:
    """Forget all but the newest ``keep`` versions and delete what only those named, or no version
    ever did. Editions numbered above the newest version may be in the making and stay."""
    lists = _lists(spark, table)
    if not lists or keep < 1:
        return
    for path in lists[:-keep]:
        delete(spark, path)
    kept = [_read_list(spark, p) for p in lists[-keep:]]
    named = frozenset().union(*(v.places for v in kept))
    for p in _folders(spark, table) - named:
        if int(p.edition[:8]) <= kept[-1].number:
            delete(spark, f"{table}/data/{EDITION}={p.edition}/{PARTITION_YEAR}={p.year}/{PARTITION_MONTH}={p.month}")


def append_batch(batch: DataFrame, batch_id: int, table: str, compact_above: int = 0) -> None:
    """Clean one micro-batch into the table; a batch that a version already counts is left out.

    With ``compact_above`` months of more than so many editions are compacted after the batch.
    """
    spark, old = batch.sparkSession, newest(batch.sparkSession, table)
    if batch_id > old.last_batch:
        staged = f"{table}/staged/{uuid.uuid4().hex[:12]}"
        try:
            rows = stage(with_identity(before_dedupe(batch)), f"{staged}/rows")
            fresh = drop_known_staged(rows, read(spark, table, old), f"{staged}/known")
            _publish(fresh, table, old, set(), batch_id, lambda df, path: write_once(df, path, staged))
        finally:
            delete(spark, staged)
    if compact_above:
        compact(spark, table, compact_above)


def append_stream(
    stream: DataFrame, table: str, checkpoint: str, every: str | None = None, compact_above: int = 0
) -> StreamingQuery:
    """Every micro-batch as a version of the table. One checkpoint for one table."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, table, compact_above)

    return start(stream.writeStream.foreachBatch(sink), checkpoint, every)
