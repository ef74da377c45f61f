import glob

import pytest
from pyspark.sql import functions as F

from visitgrain.sources import incremental
from visitgrain.sources.visits import STAR_TABLES, table_path, visits_view


@pytest.fixture
def star(spark, sf_dir, folder):
    """A folder of base tables whose fact rows are added by a condition on the order's key."""
    place = folder("star")
    for t in STAR_TABLES:
        if t not in incremental.FACTS:
            spark.read.parquet(table_path(sf_dir, t)).write.parquet(table_path(place, t))

    def more(table, condition):
        rows = spark.read.parquet(table_path(sf_dir, table)).withColumn("k", F.col(incremental.FACTS[table]))
        rows.where(condition).drop("k").coalesce(1).write.mode("append").parquet(table_path(place, table))

    return place, more


def same(spark, star, table):
    want = visits_view(spark, star)
    got = table.select(*want.columns)
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0


def files(target):
    return set(glob.glob(f"{target}/g*/visits/visit_year=*/visit_month=*/*.parquet"))


def test_lines_and_orders_come_in_any_order(spark, star, folder):
    place, more = star
    target = folder("visits")
    more("lineitem", "k % 3 = 0")
    more("orders", "k % 2 = 0")
    assert same(spark, place, incremental.extend(spark, place, target))
    first = files(target)
    more("lineitem", "k % 3 = 1")
    assert same(spark, place, incremental.extend(spark, place, target))
    more("orders", "k % 2 = 1")
    more("lineitem", "k % 3 = 2")
    assert same(spark, place, incremental.extend(spark, place, target))
    assert first < files(target)  # nothing was written anew
    before = files(target)
    incremental.extend(spark, place, target)
    assert files(target) == before


def test_only_touched_months_get_files(spark, star, folder):
    place, more = star
    target = folder("visits")
    more("lineitem", "true")
    more("orders", "o_orderdate < DATE'2000-03-01' OR o_orderdate >= DATE'2000-04-01'")
    incremental.extend(spark, place, target)
    before = files(target)
    more("orders", "o_orderdate >= DATE'2000-03-01' AND o_orderdate < DATE'2000-04-01'")
    assert same(spark, place, incremental.extend(spark, place, target))
    added = files(target) - before
    assert added and all("visit_year=2000/visit_month=3/" in f for f in added) and before < files(target)


def test_broken_extension_adds_nothing_twice(spark, star, folder, monkeypatch):
    place, more = star
    target = folder("visits")
    more("lineitem", "k % 2 = 0")
    more("orders", "true")
    incremental.extend(spark, place, target)
    more("lineitem", "k % 2 = 1")
    write = incremental.write_visits

    def stop(*args, **kw):
        write(*args, **kw)
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "write_visits", stop)
    with pytest.raises(RuntimeError):
        incremental.extend(spark, place, target)
    monkeypatch.setattr(incremental, "write_visits", write)
    assert same(spark, place, incremental.extend(spark, place, target))


def test_a_new_dimension_file_builds_anew(spark, star, folder):
    place, more = star
    target = folder("visits")
    more("lineitem", "true")
    more("orders", "k % 2 = 0")
    incremental.extend(spark, place, target)
    with pytest.raises(FileNotFoundError):
        incremental.current(spark, folder("none"))
    part = spark.read.parquet(table_path(place, "part"))
    part.withColumn("p_partkey", -F.col("p_partkey") - 1).coalesce(1).write.mode("append").parquet(table_path(place, "part"))
    more("orders", "k % 2 = 1")
    assert same(spark, place, incremental.extend(spark, place, target))
    assert len(glob.glob(f"{target}/g*")) == 2
