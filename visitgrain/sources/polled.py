"""Records polled from an endpoint, as a stream whose offset is the event time.

The caller gives the endpoint: an object with ``latest()``, the newest event time it holds (None while it is
empty), and ``records(low, high)``, its records later than ``low`` (None: from the beginning) up to
and with ``high``, as mappings. It is pickled to the executors, so it should hold settings, not connections.

Each trigger asks for the newest time and reads what came since the last one; the span is cut into
parts that tasks fetch, so records don't pass through the driver. ``records`` may be a generator: a task takes
them one after the other and never holds all of a part in memory. Offsets are in the stream's
checkpoint: a restart goes on after the last finished batch, and a batch that is run again asks for the same span.

An outage (``OSError``) while the newest time is asked for leaves it as it was, so the next trigger asks
again; one while records are fetched is retried after ``wait`` seconds, ``retries`` times, then fails the
task, which Spark runs again.
"""

from __future__ import annotations

import datetime as dt
import pickle
import tempfile
import time
import zlib
from collections.abc import Iterable, Iterator, Mapping
from itertools import islice
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from visitgrain.schema import TEXT_SCHEMA


#: Records of a span that a task holds in memory at once.
HELD = 1000


class Endpoint(Protocol):
    def latest(self) -> dt.datetime | None: ...

    def records(self, low: dt.datetime | None, high: dt.datetime) -> Iterable[Mapping[str, Any]]: ...


class Span(InputPartition):
    """Event times after ``low`` up to and with ``high``, as ISO texts; ``low`` may be empty."""

    def __init__(self, low: str, high: str):
        self.low, self.high = low, high


def spans(low: str, high: str, parts: int) -> list[Span]:
    """The span in ``parts`` of equal length; without a lower end it is one."""
    if not high or low == high:
        return []
    if not low:
        return [Span("", high)]
    a, b = dt.datetime.fromisoformat(low), dt.datetime.fromisoformat(high)
    edges = [a + (b - a) * i / parts for i in range(parts)] + [b]
    return [Span(x.isoformat(), y.isoformat()) for x, y in zip(edges, edges[1:]) if x < y]


def fetch(endpoint: Endpoint, span: Span, names: list[str], retries: int, wait: float) -> Iterator[tuple]:
    """The span's rows. None is given out before the request has ended well, so a repeated one repeats no row;
    till then they wait in a temporary file, and memory holds ``HELD`` of them."""
    low = dt.datetime.fromisoformat(span.low) if span.low else None
    for attempt in range(retries + 1):
        with tempfile.TemporaryFile() as held:
            try:
                records = iter(endpoint.records(low, dt.datetime.fromisoformat(span.high)))
                while rows := [_row(r, names) for r in islice(records, HELD)]:
                    pickle.dump(zlib.compress(pickle.dumps(rows), 1), held)
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(wait)
                continue
            end = held.tell()
            held.seek(0)
            while held.tell() < end:
                yield from pickle.loads(zlib.decompress(pickle.load(held)))
            return


def _row(record: Mapping[str, Any], names: list[str]) -> tuple:
    return tuple(None if record.get(n) is None else str(record[n]) for n in names)


class _Poll(DataSourceStreamReader):
    def __init__(self, endpoint: Endpoint, names: list[str], since: str, parts: int, retries: int, wait: float):
        self.endpoint, self.names, self.parts, self.retries, self.wait = endpoint, names, parts, retries, wait
        self.since = self.known = since

    def initialOffset(self) -> dict:
        return {"until": self.since}

    def latestOffset(self, *_) -> dict:
        try:
            newest = self.endpoint.latest()
        except OSError:
            newest = None
        if newest is not None:
            self.known = max(self.known, newest.isoformat())
        return {"until": self.known}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        # After a restart the checkpoint knows a later time than this object.
        self.known = max(self.known, end["until"])
        return spans(start["until"], end["until"], self.parts)

    def read(self, partition: Span) -> Iterator[tuple]:
        return fetch(self.endpoint, partition, self.names, self.retries, self.wait)


class _Once(DataSourceReader):
    def __init__(self, endpoint: Endpoint, names: list[str], since: str, parts: int, retries: int, wait: float):
        self.endpoint, self.names, self.since, self.parts, self.retries, self.wait = endpoint, names, since, parts, retries, wait

    def partitions(self) -> list[Span]:
        newest = self.endpoint.latest()
        return spans(self.since, newest.isoformat(), self.parts) if newest else [Span("", "")]

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.high:
            return iter(())
        return fetch(self.endpoint, partition, self.names, self.retries, self.wait)


def register(
    spark: SparkSession,
    name: str,
    endpoint: Endpoint,
    schema: T.StructType = TEXT_SCHEMA,
    since: dt.datetime | None = None,
    parts: int = 8,
    retries: int = 3,
    wait: float = 30.0,
) -> None:
    """Make ``endpoint`` a source of the session, for ``spark.read`` and ``spark.readStream``.

    All columns are text, to be cast while cleaning; ``since`` leaves out what is not later.
    """
    first, names, given = since.isoformat() if since else "", schema.names, schema

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return given

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Once(endpoint, names, first, parts, retries, wait)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _Poll(endpoint, names, first, parts, retries, wait)

    spark.dataSource.register(Polled)


def read_polled(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.format(name).load()


def poll(spark: SparkSession, name: str) -> DataFrame:
    """The stream; how often it asks is the trigger's ``processingTime``."""
    return spark.readStream.format(name).load()


class FolderEndpoint:
    """JSON-lines files of a folder as an endpoint, by any store that pyarrow's file systems reach.

    Files may be added at any time. With ``by`` they lie in folders ``by=YYYY-MM`` of their months, and a span
    reads its own months only; without it every span reads every file.
    """

    def __init__(self, folder: str, ts: str, by: str | None = None):
        self.folder, self.ts, self.by = folder, ts, by

    def _files(self) -> list[str]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted(i.path for i in found if i.is_file and i.extension == "json")

    def _month(self, path: str) -> str:
        return path.rsplit(f"/{self.by}=", 1)[1][:7] if self.by else ""

    def _records(self, low: str = "", high: str = "~") -> Iterator[Mapping[str, Any]]:
        """Records of the files whose month is within ``low`` and ``high``, both included."""
        import io
        import json

        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        for path in self._files():
            if not self.by or low <= self._month(path) <= high:
                with store.open_input_stream(path) as file:
                    for line in io.TextIOWrapper(io.BufferedReader(file, 1 << 20), "utf-8"):
                        if not line.isspace():
                            yield json.loads(line)

    def _time(self, record: Mapping[str, Any]) -> dt.datetime:
        return dt.datetime.fromisoformat(record[self.ts])

    def latest(self) -> dt.datetime | None:
        newest = max((self._month(f) for f in self._files()), default="")
        return max((self._time(r) for r in self._records(newest)), default=None)

    def records(self, low: dt.datetime | None, high: dt.datetime) -> Iterable[Mapping[str, Any]]:
        months = (f"{low:%Y-%m}" if low else "", f"{high:%Y-%m}")
        return (r for r in self._records(*months) if (low is None or self._time(r) > low) and self._time(r) <= high)
