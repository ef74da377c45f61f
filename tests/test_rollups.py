"""Roll-ups: the rows of the plain queries, without reading visits again."""

import pytest
from pyspark.sql import functions as F

from visitgrain.plans import patients, revenue, rolled, visits as vis
from visitgrain.schema import EVENT_TIME, VISIT_SCHEMA
from visitgrain.sources import rollups
from visitgrain.sources.tables import read_stored_visits, write_visits
from visitgrain.sources.visits import visits_view

TS = EVENT_TIME
PAIRS = [
    (rolled.growth, vis.growth), (rolled.patients_by_gender, patients.by_gender), (rolled.unique_patients, patients.unique_patients),
    (rolled.patients_by_gender_over_time, patients.by_gender_over_time), (rolled.patients_by_age, patients.by_age),
    (rolled.revenue_over_time, revenue.over_time), (rolled.revenue_by_registration_type, revenue.by_registration_type),
    (rolled.new_per_year, patients.new_per_year),
]


@pytest.fixture
def stored(spark, visits, folder):
    """Visits at hours of the day, so that a range may begin inside one."""
    path = folder("visits")
    hour = F.expr("make_dt_interval(0, int(id_registrasi % 24))")
    write_visits(visits.withColumn(TS, F.col(TS) + hour), path, mode="error")
    return path


def rows(df):
    # Sums of doubles differ in their last bits; the nudge moves exact halves off the edge of rounding.
    return sorted((tuple(round(x + 1.3e-5, 3) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def moved(visits, when, **more):
    out = visits.withColumn(TS, F.lit(when).cast("timestamp_ntz"))
    return out.withColumns({k: F.lit(x).cast(out.schema[k].dataType) for k, x in more.items()}).select(*VISIT_SCHEMA.names)


@pytest.mark.parametrize("new,plain", PAIRS, ids=lambda f: f.__name__)
def test_equal_plain_queries_before_and_after_a_load(spark, visits, stored, new, plain):
    sets = [{}, {"year": 2000}, {"year": 2000, "month": 5}, {"year": 2000, "district": "NATION_3"}]
    for _ in range(2):
        v = read_stored_visits(spark, stored)
        for kw in sets:
            assert rows(new(v, **kw)) == rows(plain(v, **kw)), kw
        write_visits(moved(visits.limit(20), "2001-08-20 13:30:00").unionByName(moved(visits.limit(3), "1993-01-01")), stored)


def test_a_load_changes_only_its_months(spark, visits, stored):
    v = read_stored_visits(spark, stored)
    rollups.ensure(v, rollups.DAILY)
    base = f"{stored}/{rollups.FOLDER}/daily"
    first = rollups._stored(spark, base)
    write_visits(moved(visits.limit(2), "2000-05-05 10:00:00"), stored)
    w = read_stored_visits(spark, stored)
    rollups.ensure(w, rollups.DAILY)
    fresh = {k[:2] for k in rollups._stored(spark, base)} and {k[:2] for k in rollups._stored(spark, base) if k not in first}
    assert fresh == {(2000, 5)}
    # The earlier frame still has its own rows.
    assert rollups.ensure(v, rollups.DAILY).agg(F.sum(rollups.N)).first()[0] == v.count() == w.count() - 2
    rollups.clear_old(w, rollups.DAILY)
    assert rollups.ensure(w, rollups.DAILY).agg(F.sum(rollups.N)).first()[0] == w.count()


def test_late_row_moves_a_first_visit(spark, visits, stored):
    v = read_stored_visits(spark, stored)
    before = dict(map(tuple, rolled.new_per_year(v).collect()))
    last = v.groupBy("id_pasien").agg(F.min(TS).alias("t")).orderBy(F.desc("t"), "id_pasien").first()
    write_visits(moved(visits.limit(1), "1990-02-03", id_pasien=last.id_pasien), stored)
    after = dict(map(tuple, rolled.new_per_year(read_stored_visits(spark, stored)).collect()))
    assert after[1990] == 1 and after[last.t.year] == before[last.t.year] - 1


def test_plans_read_no_visits_and_shuffle_no_patients(spark, stored):
    v = read_stored_visits(spark, stored)
    rolled.unique_patients(v), rolled.growth(v), rolled.new_per_year(v)
    for df in (rolled.unique_patients(v, year=2000), rolled.patients_by_age(v), rolled.growth(v, year=2000)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "id_pasien" not in text and "id_registrasi" not in text
        assert all("/_rollups/" in f for f in df.inputFiles())


def test_other_frames_use_the_plain_query(spark, sf_dir, stored):
    view = visits_view(spark, sf_dir)
    assert rollups.ensure(view, rollups.DAILY) is None
    v = read_stored_visits(spark, stored)
    some = v.where("jenis_kelamin = 'Perempuan'")
    assert rollups.ensure(some, rollups.DAILY) is None and rows(rolled.growth(some, year=2000)) == rows(vis.growth(some, year=2000))


def test_interrupted_refresh_counts_for_nothing(spark, stored):
    v = read_stored_visits(spark, stored)
    want = rows(rollups.ensure(v, rollups.DAILY).groupBy("jenis_registrasi").agg(F.sum(rollups.N)))
    base = f"{stored}/{rollups.FOLDER}/daily"
    (k, leaf), *_ = rollups._stored(spark, base).items()
    twin = leaf.replace(f"{rollups.REFRESH}=", f"{rollups.REFRESH}=0")  # rows without the mark of a finished write
    spark.read.parquet(leaf).write.parquet(twin)
    assert rows(rollups.ensure(v, rollups.DAILY).groupBy("jenis_registrasi").agg(F.sum(rollups.N))) == want


def test_empty_table(spark, visits, folder):
    write_visits(visits.limit(0), folder("none"), mode="error")
    v = read_stored_visits(spark, folder("none"))
    assert rolled.unique_patients(v).first()[0] == 0 and rolled.growth(v).collect() == []


def test_the_visits_of_a_roll_up_are_read_in_bounded_parts(spark, stored, monkeypatch):
    from pyspark.sql import DataFrameWriter

    key, seen, write = "spark.sql.files.maxPartitionBytes", [], DataFrameWriter.parquet
    before, v = spark.conf.get(key, None), read_stored_visits(spark, stored)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(int(spark.conf.get(key).rstrip("b"))), write(self, *a, **b))[1])
    assert rows(rolled.patients_by_age(v)) == rows(patients.by_age(v))
    assert seen and max(seen) <= 24 << 20
    assert spark.conf.get(key, None) == before
