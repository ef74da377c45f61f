import glob
import os

import pytest
from pyspark.sql import functions as F

from visitgrain.streaming import windows

SCHEMA = "time_period timestamp, kind string, n long, total double"
KEYS = [windows.WINDOW, "kind"]


@pytest.fixture
def series(spark):
    def make(*rows):
        df = spark.createDataFrame([(d, k, n, float(n)) for d, k, n in rows], SCHEMA.replace("timestamp", "string"))
        return df.withColumn(windows.WINDOW, F.col(windows.WINDOW).cast("timestamp"))

    return make


def state(spark, target, schema):
    return {(str(r[0])[:10], r[1]): r[2] for r in windows.read_live(spark, target, schema).collect()}


def test_only_spans_of_changed_windows_are_written(spark, series, folder):
    target, schema = folder("live"), series(("2024-01-01", "a", 1)).schema
    assert state(spark, target, schema) == {}
    windows.upsert(series(("2024-01-01", "a", 1), ("2024-06-01", "a", 2), ("2024-06-01", None, 9)), 0, target, KEYS)
    windows.upsert(series(("2024-06-01", "a", 5), ("2024-06-02", "b", 3)), 1, target, KEYS)
    want = {("2024-01-01", "a"): 1, ("2024-06-01", "a"): 5, ("2024-06-01", None): 9, ("2024-06-02", "b"): 3}
    assert state(spark, target, schema) == want
    assert len(os.listdir(f"{target}/data/batch=0")) > len([d for d in os.listdir(f"{target}/data/batch=1") if "span" in d]) == 1
    windows.upsert(series(("2024-06-01", "a", 5), ("2024-06-02", "b", 3)), 1, target, KEYS)  # a replay
    windows.upsert(series(), 2, target, KEYS)
    assert state(spark, target, schema) == want


def test_old_states_go_and_readers_keep_theirs(spark, series, folder):
    target, schema = folder("live"), series(("2024-01-01", "a", 1)).schema
    windows.upsert(series(("2023-01-01", "a", 7), ("2024-01-01", "a", 0)), 0, target, KEYS)
    held = None
    for i in range(1, 5):
        windows.upsert(series(("2024-01-01", "a", i)), i, target, KEYS)
        if i == 3:
            held = windows.read_live(spark, target, schema)
    assert sorted(r[2] for r in held.collect()) == [3, 7]
    assert state(spark, target, schema) == {("2023-01-01", "a"): 7, ("2024-01-01", "a"): 4}
    assert len(glob.glob(f"{target}/lists/v*")) == 2
    assert len(glob.glob(f"{target}/data/batch=*/span=*")) == 3  # one old span, two states of the other
