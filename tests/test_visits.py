"""The visits over the star schema: the staged joins against the one text, and their shuffles."""

import pytest

from visitgrain.session import finer_shuffles
from visitgrain.sources import visits as V
from visitgrain.sources.tables import read_stored_visits

INITIAL, TARGET = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def star(spark, folder):
    """Null and repeated keys, keys without a partner, null dates."""
    made = {
        "region": ([(0, "R0"), (1, None)], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, None, 1), (2, "N2", None), (3, "N3", 9)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C1", 0, "S"), (1, "again", 1, None), (2, None, 1, "T"), (3, "C3", 2, "S"), (None, "none", 0, "S")],
                     "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "part": ([(1, "p", "B", "T", 50), (2, None, "B", None, 7), (2, "q", None, "T", None)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(1, 1, "O", "1999-05-01 00:00:00", "5-LOW"), (2, 2, "F", None, None), (2, 1, None, "2000-01-31 10:00:00", "x"),
                    (3, 3, "P", "2000-02-01 00:00:00", "x"), (None, 1, "O", "2000-02-01 00:00:00", "x"), (4, None, "O", None, "x")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string"),
        "lineitem": ([(k, p, n, 10.0, 0.1 if n else None, 2.0, "A", None if n == 2 else "F", "2000-03-01 00:00:00")
                      for k in (1, 2, 2, 3, 4, None, 9) for p in (1, 2, None, 8) for n in (1, 2, None)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_discount double, l_quantity double, "
                     "l_returnflag string, l_linestatus string, l_shipdate string"),
    }
    for name, (rows, ddl) in made.items():
        frame = spark.createDataFrame(rows, ddl)
        times = [c for c in frame.columns if c in ("o_orderdate", "l_shipdate")]
        frame.withColumns({c: frame[c].cast("timestamp_ntz") for c in times}).write.parquet(V.table_path(folder, name))
    return folder


def test_staged_joins_give_the_rows_of_the_one_text(spark, folder):
    where = star(spark, folder("star"))
    tables = {t: spark.read.parquet(V.table_path(where, t)) for t in V.STAR_TABLES}
    want = spark.sql(V.VISITS_SQL, **tables)
    view, stored = V.visits_view(spark, where), V.visits(spark, where)
    assert view.columns == want.columns and view.count() > 20
    text = lambda f: sorted(map(repr, f.select(*want.columns).collect()))
    assert text(view) == text(want) == text(stored)
    assert [f.dataType for f in view.schema] == [f.dataType for f in want.schema]
    assert stored.where("visit_year is not distinct from year(waktu_registrasi)").count() == want.count()


def test_a_pass_over_visits_does_not_store_them(spark, folder):
    where = star(spark, folder("star"))
    assert "visit_year" not in V.visits_once(spark, where).columns
    V.visits(spark, where)
    assert "visit_year" in V.visits_once(spark, where).columns


def test_rows_are_dealt_to_months_before_columns_are_made(spark, folder, monkeypatch):
    seen, write = [], V.write_dealt
    monkeypatch.setattr(V, "write_dealt", lambda df, path: (seen.append((df, spark.conf.get(INITIAL))), write(df, path)))
    monkeypatch.setattr("visitgrain.session.FINE_BYTES", 500)
    V._store(spark, star(spark, folder("star")), folder("out"))
    plan = seen[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert "concat" not in plan.split("RebalancePartitions")[1] and "concat" in plan.split("RebalancePartitions")[0]
    assert int(seen[0][1]) > 10 and spark.conf.get(INITIAL, None) is None
    assert read_stored_visits(spark, folder("out")).count() > 20


def test_finer_shuffles_go_by_the_size_and_are_put_back(spark):
    partitions, target = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(TARGET, None)
    with finer_shuffles(spark, 1):
        assert int(spark.conf.get(INITIAL)) == partitions and int(spark.conf.get(TARGET)) <= 32 << 20
    with finer_shuffles(spark, 100_000_001):
        assert int(spark.conf.get(INITIAL)) == max(partitions, 51)
    assert spark.conf.get(INITIAL, None) is None and spark.conf.get(TARGET, None) == target


def test_gzip_files_that_make_enough_tasks_are_not_dealt_anew(spark, folder):
    from visitgrain.sources.files import read_csv

    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        for files, shuffles in ((4, False), (1, True)):
            path = folder(f"csv{files}")
            spark.range(100).repartition(files).write.option("header", True).option("compression", "gzip").csv(path)
            read = read_csv(spark, path, ["id"], partitions=3)
            assert ("Repartition" in read._jdf.queryExecution().optimizedPlan().toString()) == shuffles
            assert read.count() == 100 and read.rdd.getNumPartitions() >= 3
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_writes_begin_with_partitions_by_what_they_read(spark, folder, monkeypatch):
    from visitgrain.sources import fs, tables

    where, seen = star(spark, folder("star è")), []
    v = V.visits_view(spark, where)
    assert fs.read_bytes(v) == V.base_length(spark, where) > 1000 and fs.read_bytes(spark.range(3)) == 0
    write = tables.write_dealt
    monkeypatch.setattr(tables, "write_dealt", lambda *a: (seen.append(spark.conf.get(INITIAL)), write(*a)))
    monkeypatch.setattr("visitgrain.session.FINE_BYTES", 500)
    tables.write_visits(v, folder("out"))
    assert int(seen[0]) > 10 and spark.conf.get(INITIAL, None) is None
    rows = [(r.waktu_registrasi, r.no_registrasi) for r in spark.read.parquet(f"{folder('out')}/visit_year=1999").collect()]
    assert len(rows) > 5


SCAN = "spark.sql.files.maxPartitionBytes"


def test_scans_before_a_shuffle_are_read_in_bounded_parts(spark):
    before = spark.conf.get(SCAN, None)
    try:
        for given, held in (("128m", 24 << 20), ("1g", 24 << 20), ("1m", 1 << 20)):
            spark.conf.set(SCAN, given)
            with finer_shuffles(spark, 1):
                assert int(spark.conf.get(SCAN)) == held
            assert spark.conf.get(SCAN) == given
    finally:
        spark.conf.unset(SCAN) if before is None else spark.conf.set(SCAN, before)


def test_the_build_reads_line_items_in_many_tasks(spark, folder, monkeypatch):
    where, tasks, write = star(spark, folder("star")), [], V.write_dealt

    def seen(df, path):
        tasks.append(spark.read.parquet(V.table_path(where, "lineitem")).rdd.getNumPartitions())
        write(df, path)

    monkeypatch.setattr(V, "write_dealt", seen)
    monkeypatch.setattr("visitgrain.session.FINE_SCAN", 500, raising=False)
    V._store(spark, where, folder("out"))
    outside = spark.read.parquet(V.table_path(where, "lineitem")).rdd.getNumPartitions()
    assert tasks[0] > 2 * outside
    assert read_stored_visits(spark, folder("out")).count() == V.visits_view(spark, where).count()


def test_a_query_that_builds_visits_shuffles_by_the_input_and_not_by_the_session(spark, folder):
    """The build behind a query, with one shuffle partition and no broadcasts, as where tables have outgrown them."""
    from visitgrain.registry import QUERIES

    where = folder("large")
    made = {
        "region": (1, "id AS r_regionkey, 'R' AS r_name"),
        "nation": (2, "id AS n_nationkey, 'N' AS n_name, 0L AS n_regionkey"),
        "customer": (60, "id AS c_custkey, 'C' AS c_name, id % 2 AS c_nationkey, 'S' AS c_mktsegment"),
        "part": (60, "id AS p_partkey, 'p' AS p_name, 'B' AS p_brand, 'T' AS p_type, 7 AS p_size"),
        "orders": (400, "id AS o_orderkey, id % 60 AS o_custkey, 'O' AS o_orderstatus, '5-LOW' AS o_orderpriority, "
                        "timestamp_ntz'1999-01-01 00:00:00' + make_interval(0, int(id % 3)) AS o_orderdate"),
        "lineitem": (1200, "id % 400 AS l_orderkey, id % 60 AS l_partkey, int(id DIV 400) + 1 AS l_linenumber, 10.0D AS l_extendedprice, "
                           "0.1D AS l_discount, 2.0D AS l_quantity, 'A' AS l_returnflag, 'F' AS l_linestatus, "
                           "timestamp_ntz'2000-03-01 00:00:00' AS l_shipdate"),
    }
    for name, (rows, columns) in made.items():
        spark.sql(f"SELECT {columns} FROM range(0, {rows}, 1, 1)").write.parquet(V.table_path(where, name))
    given = {"spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", TARGET: "1",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    before, context = {k: spark.conf.get(k, None) for k in given}, spark.sparkContext
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("visitgrain.session.FINE_BYTES", V.base_length(spark, where) // 20, raising=False)
        try:
            for k, v in given.items():
                spark.conf.set(k, v)
            context.setJobGroup("build", "")
            got = QUERIES["Q-1"](spark, where)
            tracker = context.statusTracker()
            stages = {s for j in tracker.getJobIdsForGroup("build") for s in tracker.getJobInfo(j).stageIds}
            tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Line items by part, orders by customer, and both by order: each is read by many tasks.
    assert sum(n >= 10 for n in tasks) >= 3, sorted(tasks)
    assert V.visits(spark, where).count() == 1200 and got.count() > 0
