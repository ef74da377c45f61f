import glob

import pytest

from test_pipelines import land, raw, record  # noqa: F401
from visitgrain.operators.clean import clean
from visitgrain.sources import versions
from visitgrain.streaming import landing

KEY, TIME = "id_registrasi", "waktu_registrasi"


def rows(frame):
    return sorted((r[KEY], str(r[TIME])[:10]) for r in frame.select(KEY, TIME).collect())


def visit(i, day):
    return record(**{KEY: i, TIME: f"{day} 08:00:00"})


@pytest.fixture
def table(spark, raw, folder):  # noqa: F811
    place = folder("table")
    versions.append(clean(raw(visit(1, "2024-01-05"), visit(2, "2024-02-05"))), place)
    versions.append(clean(raw(visit(2, "2024-02-05"), visit(3, "2024-02-06"), visit(4, "2024-03-01"))), place)
    return place


FIRST = [(1, "2024-01-05"), (2, "2024-02-05"), (3, "2024-02-06"), (4, "2024-03-01")]


def test_append_leaves_known_keys_out_and_prunes_months(spark, table):
    frame = versions.read(spark, table)
    assert rows(frame) == FIRST
    march = frame.where("visit_year = 2024 AND visit_month = 3")
    assert "visit_month" in march._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert rows(march) == FIRST[3:]


def test_a_reader_sees_one_version_whole(spark, raw, table):  # noqa: F811
    before = versions.read(spark, table)
    versions.upload(spark, table, raw(visit(3, "2024-01-20"), visit(4, "2024-04-01"), visit(5, "2024-02-07")))
    # 3 moves to an earlier time, 4 stays where it was
    after = [(1, "2024-01-05"), (2, "2024-02-05"), (3, "2024-01-20"), (4, "2024-03-01"), (5, "2024-02-07")]
    uploaded = versions.read(spark, table)
    assert rows(before) == FIRST and rows(uploaded) == after
    versions.compact(spark, table)
    versions.expire(spark, table)
    assert rows(uploaded) == rows(versions.read(spark, table)) == after
    assert not glob.glob(f"{table}/staged/*")


def test_upload_rewrites_touched_months_only(spark, raw, table):  # noqa: F811
    before = versions.newest(spark, table)
    versions.upload(spark, table, raw(visit(9, "2024-02-09")))
    after = versions.newest(spark, table)
    assert {(p.year, p.month) for p in before.places - after.places} == {(2024, 2)}
    assert {(p.year, p.month) for p in after.places - before.places} == {(2024, 2)}


def test_compaction_and_expiry(spark, table):
    old = versions.newest(spark, table)
    assert sum(p.month == 2 for p in old.places) == 2
    made = versions.compact(spark, table)
    assert sum(p.month == 2 for p in made.places) == 1 and rows(versions.read(spark, table)) == FIRST
    assert versions.compact(spark, table).number == made.number  # nothing left to do
    versions.expire(spark, table, keep=1)
    assert versions._folders(spark, table) == set(made.places)
    assert rows(versions.read(spark, table)) == FIRST


def test_a_broken_change_is_never_seen(spark, raw, table, monkeypatch):  # noqa: F811
    write = versions.write_visits

    def stop(*args, **kw):
        write(*args, **kw)
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "write_visits", stop)
    with pytest.raises(RuntimeError):
        versions.append(clean(raw(visit(7, "2024-03-07"))), table)
    monkeypatch.setattr(versions, "write_visits", write)
    assert rows(versions.read(spark, table)) == FIRST
    versions.append(clean(raw(visit(7, "2024-03-07"))), table)
    assert rows(versions.read(spark, table)) == [*FIRST, (7, "2024-03-07")]
    versions.expire(spark, table, keep=1)  # what the broken attempt left goes
    assert versions._folders(spark, table) == set(versions.newest(spark, table).places)


def test_empty_tables_and_loads(spark, raw, folder):  # noqa: F811
    place = folder("none")
    assert versions.read(spark, place).count() == 0
    versions.expire(spark, place)
    versions.append(clean(raw()), place)
    versions.upload(spark, place, raw())
    assert versions.read(spark, place).count() == 0 and versions.newest(spark, place).number == 2


def test_stream_into_versions(spark, folder, tmp_path):
    table = folder("live")
    for i in range(3):
        land(tmp_path / "in", f"{i}.json", [visit(i, "2024-05-01"), visit(100 + i, "2024-05-02"), visit(0, "2024-05-01")])
    for _ in range(2):
        stream = landing.read_landing(spark, folder("in"), files_per_batch=1)
        versions.append_stream(stream, table, folder("cp"), compact_above=2).awaitTermination()
    want = sorted([(i, "2024-05-01") for i in range(3)] + [(100 + i, "2024-05-02") for i in range(3)])
    assert rows(versions.read(spark, table)) == want
    assert len(versions.newest(spark, table).places) <= 2
    versions.append_batch(spark.read.schema(stream.schema).json(folder("in")), 2, table)  # a replay
    assert rows(versions.read(spark, table)) == want
