import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from visitgrain.session import local_session

    session = local_session(
        8,
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.shuffle.partitions": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def visits(spark, sf_dir):
    from visitgrain.sources.visits import visits

    return visits(spark, sf_dir)


@pytest.fixture
def frame(spark):
    """Rows and a DDL schema to a DataFrame; ``ts`` text becomes a timestamp without zone."""

    def make(rows, ddl):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, ddl)
        times = [c for c in df.columns if c in ("ts", "waktu_registrasi", "time_period")]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})

    return make


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)
