"""Polling: offsets over restarts, outages, parts; files stand in for the endpoint."""

import datetime as dt
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from visitgrain.sources import polled
from visitgrain.streaming.landing import start

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors can't import tests

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "ts", "note")])


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps({"id": i, "ts": t, "other": 1}) + "\n" for i, t in rows)


class Flaky(polled.FolderEndpoint):
    """Fails while a file named ``down`` holds a count above zero, which each failure lowers."""

    def _records(self, *months):
        mark = f"{self.folder}/down"
        left = int(open(mark).read() or 0) if os.path.exists(mark) else 0
        if left:
            with open(mark, "w") as f:
                f.write(str(left - 1))
            raise ConnectionError("the endpoint is down")
        return super()._records(*months)


def run(spark, name, folder):
    query = start(polled.poll(spark, name).writeStream.format("parquet").option("path", f"{folder}-out"), f"{folder}-check", None)
    assert query.awaitTermination(120)
    return sorted((r.id, r.ts, r.note) for r in spark.read.schema(SCHEMA).parquet(f"{folder}-out").collect())


def test_spans_cover_once():
    made = polled.spans("2020-01-01T00:00:00", "2020-01-02T00:00:00", 7)
    assert len(made) == 7 and made[0].low == "2020-01-01T00:00:00" and made[-1].high == "2020-01-02T00:00:00"
    assert all(a.high == b.low for a, b in zip(made, made[1:]))
    assert polled.spans("", "", 4) == [] and polled.spans("x", "x", 4) == [] and len(polled.spans("", "2020-01-01", 4)) == 1


def test_restart_goes_on_after_the_last_time(spark, folder):
    where = folder("in")
    put(where, "a", [(i, f"2020-01-{1 + i % 9:02d}T0{i % 10}:00:00") for i in range(30)])
    polled.register(spark, "poll_restart", polled.FolderEndpoint(where, "ts"), SCHEMA, parts=3)
    first = run(spark, "poll_restart", where)
    assert len(first) == 30 and first[0][2] is None and first[0][0] == "0"
    assert run(spark, "poll_restart", where) == first  # nothing new
    put(where, "b", [(100 + i, f"2020-02-{1 + i:02d}T00:00:00") for i in range(20)] + [(999, "2019-01-01T00:00:00")])
    second = run(spark, "poll_restart", where)
    assert len(second) == 50 and "999" not in {r[0] for r in second}  # not later than what was read


def test_outage_is_retried(spark, folder):
    where = folder("in")
    put(where, "a", [(i, f"2020-01-01T00:00:{i:02d}") for i in range(10)])
    with open(f"{where}/down", "w") as f:
        f.write("1")
    polled.register(spark, "poll_flaky", Flaky(where, "ts"), SCHEMA, retries=2, wait=0.01)
    run_once = start(polled.poll(spark, "poll_flaky").writeStream.format("parquet").option("path", f"{where}-out"), f"{where}-check", None)
    assert run_once.awaitTermination(120)  # the newest time can't be asked for: no batch, no failure
    assert len(run(spark, "poll_flaky", where)) == 10


def test_fetch_gives_up_after_its_retries(folder):
    where = folder("in")
    put(where, "a", [(1, "2020-01-01T00:00:00")])
    for down, ok in ((2, True), (3, False)):
        with open(f"{where}/down", "w") as f:
            f.write(str(down))
        read = lambda: list(polled.fetch(Flaky(where, "ts"), polled.Span("", "2020-01-01T00:00:00"), SCHEMA.names, 2, 0.0))
        if ok:
            assert read() == [("1", "2020-01-01T00:00:00", None)]
        else:
            with pytest.raises(ConnectionError):
                read()


def test_folders_of_months(spark, folder):
    where = folder("in")
    for month in ("2020-01", "2020-02", "2020-03"):
        put(f"{where}/month={month}", "a", [(f"{month}-{i}", f"{month}-{i:02d}T00:00:00") for i in range(1, 11)])
    ends = polled.FolderEndpoint(where, "ts", "month")
    assert ends.latest() == dt.datetime(2020, 3, 10)
    polled.register(spark, "poll_months", ends, SCHEMA, since=dt.datetime(2020, 1, 5), parts=5)
    assert len(polled.read_polled(spark, "poll_months").collect()) == 25
    opened = []
    monthly = polled.FolderEndpoint(where, "ts", "month")
    monthly._time, real = lambda r: opened.append(r["ts"][:7]) or real(r), monthly._time
    assert len(list(monthly.records(dt.datetime(2020, 2, 3), dt.datetime(2020, 2, 6)))) == 3 and set(opened) == {"2020-02"}


def test_batch_read_and_empty_endpoint(spark, folder):
    where = folder("in")
    os.makedirs(where)
    polled.register(spark, "poll_batch", polled.FolderEndpoint(where, "ts"), SCHEMA, since=dt.datetime(2020, 1, 2))
    assert polled.read_polled(spark, "poll_batch").collect() == []
    put(where, "a", [(i, f"2020-01-{i:02d}T00:00:00") for i in range(1, 11)])
    assert sorted(int(r.id) for r in polled.read_polled(spark, "poll_batch").collect()) == list(range(3, 11))


class Rec(dict):
    live = most = 0

    def __init__(self, **given):
        super().__init__(**given)
        Rec.live += 1
        Rec.most = max(Rec.most, Rec.live)

    def __del__(self):
        Rec.live -= 1


class Many:
    """5,000 records, one after the other; the first requests break off in the middle."""

    def __init__(self, broken=0):
        self.broken = broken

    def records(self, low, high):
        for i in range(5000):
            if self.broken and i == 3210:
                self.broken -= 1
                raise ConnectionError("gone")
            yield Rec(id=i, ts="t")


def test_a_part_is_not_held_in_memory_and_a_broken_request_repeats_no_row():
    span = polled.Span("", "2020-01-01T00:00:00")
    want = [(str(i), "t", None) for i in range(5000)]
    for broken in (0, 2):
        Rec.live = Rec.most = 0
        assert list(polled.fetch(Many(broken), span, SCHEMA.names, 2, 0.0)) == want
        assert Rec.most <= polled.HELD + 1
    rows = polled.fetch(Many(3), span, SCHEMA.names, 2, 0.0)
    with pytest.raises(ConnectionError):
        next(rows)


def test_files_are_read_by_lines(folder):
    import tracemalloc

    where = folder("in")
    put(where, "a", [(f"\u2028\x85{i:0200d}", "2020-01-01T00:00:00") for i in range(50_000)])
    with open(f"{where}/a.json", "a") as f:
        f.write("\n" + json.dumps({"id": "\u2028", "ts": "2020-01-01T00:00:00"}, ensure_ascii=False) + "\r\n")
    ends = polled.FolderEndpoint(where, "ts")
    list(zip(range(1), ends.records(None, dt.datetime(2021, 1, 1))))  # modules are loaded
    tracemalloc.start()
    found = sum(1 for _ in ends.records(None, dt.datetime(2021, 1, 1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 50_001 and peak < 6_000_000 < os.path.getsize(f"{where}/a.json") / 2
