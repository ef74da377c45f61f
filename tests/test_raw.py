import json

from pyspark.sql import functions as F

from visitgrain.registry import raw
from visitgrain.sources.fs import children, finished


def test_json_files_are_bounded_and_grow_with_the_table(spark, folder):
    rows = spark.range(0, 1000, 1, 3).select("id", F.concat(F.lit("é, [\n"), "id").alias("t"), F.lit(None).cast("int").alias("n"))
    raw._write_json_files(rows, folder("lines"), size=100)
    read = spark.read.schema(rows.schema).json(folder("lines"), multiLine=True)
    counts = [r["count"] for r in read.groupBy(F.input_file_name()).count().collect()]
    assert max(counts) <= 100 and len(counts) >= 10
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))


def test_json_arrays_are_compressed_and_written_by_the_tasks_that_hold_the_records(spark, folder):
    rows = spark.range(0, 1000, 1, 3).select("id", F.concat(F.lit("é, [\n"), "id").alias("t"), F.lit(None).cast("int").alias("n"))
    raw._write_json_arrays(rows, folder("arrays"), size=50, per_file=100)
    files = [n for n in children(spark, folder("arrays")) if n.startswith("part-")]
    assert len(files) == 12 and all(n.endswith(".gz") for n in files)
    lines = [json.loads(r.value) for r in spark.read.text(folder("arrays")).collect()]
    assert max(map(len, lines)) == 50 and len(lines) == 21
    assert all([r["id"] for r in x] == list(range(x[0]["id"], x[-1]["id"] + 1)) for x in lines)  # no shuffle
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(folder("arrays")).collect())) == sorted(map(tuple, rows.collect()))
    assert raw.json_share(spark, folder("arrays"), 1) == 2 and raw.json_share(spark, folder("arrays"), 6) == 12


def test_raw_records_are_made_without_storing_the_visits(spark, folder):
    from visitgrain.sources.visits import STAR_TABLES, table_path

    made = folder("star")
    for name in STAR_TABLES:
        spark.read.parquet(table_path("/root/testdata/sf0.001", name)).write.parquet(table_path(made, name))
    before = set(finished(spark, f"{spark.conf.get('spark.checkpoint.dir')}/visitgrain-visits-*"))
    path = raw.json_path(spark, made)
    assert spark.read.json(path).count() == spark.read.parquet(table_path(made, "lineitem")).count()
    assert raw.json_share(spark, path, 6) >= 6
    assert set(finished(spark, f"{spark.conf.get('spark.checkpoint.dir')}/visitgrain-visits-*")) == before


def test_records_lie_in_files_of_a_size_that_a_task_reads(spark, folder, monkeypatch):
    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "'a, b' AS t")
    monkeypatch.setattr(raw, "FILE_RECORDS", 100)
    raw._write_csv(rows, folder("csv"), "gzip")
    files = [n for n in children(spark, folder("csv")) if n.startswith("part-")]
    assert len(files) == 10 and all(n.endswith(".csv.gz") for n in files)
    read = spark.read.schema(rows.schema).option("header", True).csv(folder("csv"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
