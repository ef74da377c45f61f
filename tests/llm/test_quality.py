import os

import pytest
from pyspark.sql import functions as F

from visitgrain.llm import quality
from visitgrain.llm.common import read_table
from visitgrain.llm.queries import held_out, op2_quality_classifier


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def texts(n):
    good = [f"The plain sentence number {i} speaks of river {i * 7} and meadow {i * 3}." * 3 for i in range(n)]
    bad = [f"BUY!! NOW!! OFFER{i}!! $$$ FREE!! CLICK{i * 5}!! ###" * 4 for i in range(n)]
    return good, bad


def test_learns_from_text_alone(documents, labels):
    good, bad = texts(60)
    docs = documents(good + bad)
    known = labels([(i, int(i < 60), 0) for i in range(120) if i % 4])
    model = quality.fit(docs, known)
    rows = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert all(rows[i] > 0.7 for i in range(0, 60, 4)) and all(rows[i] < 0.5 for i in range(60, 120, 4))
    assert model == quality.fit(docs, known)


def test_odd_texts_and_labels(documents, labels, odd_texts, spark):
    docs = documents(odd_texts)
    for rows, prior in (
        ([], 0.5),
        ([(3, 1, 0), (4, 1, 0)], 3 / 4),
        ([(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], 0.5),
    ):
        model = quality.fit(docs, labels(rows))
        scores = [r.score for r in quality.score_documents(docs, model).collect()]
        assert len(scores) == len(odd_texts) and set(scores) == {prior}
    model = quality.fit(docs, labels([(i, i % 2, 0) for i in range(len(odd_texts))]))
    out = quality.score_documents(docs, model, ("doc_id", "score", "text")).collect()
    assert len(out) == len(odd_texts) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.text for r in out}[0] is None
    empty = quality.fit(documents([]), labels([]))
    assert quality.score_documents(documents([]), empty).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    folder = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    out = op2_quality_classifier(spark, folder).join(read_table(spark, folder, "labels"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.93


def test_held_out_rows(spark):
    import zlib

    ids = [*range(200), None]
    out = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
