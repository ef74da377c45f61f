"""Raw registration records derived from the visits table: text columns, uncleaned labels.

One SQL text for Spark and DuckDB, so that cleaning starts from the same records in both.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.schema import COLUMNS, VISIT_SCHEMA
from visitgrain.session import finer_shuffles
from visitgrain.sources.fs import children
from visitgrain.sources.visits import base_length, stored_once, table_path, visits_once

# How each text column is made; columns not named are only cast.
_MESSY = {
    "jenis_kelamin": """CASE WHEN usia = 33 THEN 'Ambigu' WHEN usia < 20 THEN lower(jenis_kelamin)
        ELSE jenis_kelamin END""",
    "kabupaten": """CASE kabupaten WHEN 'NATION_1' THEN 'KABUPATEN S I A K' WHEN 'NATION_2' THEN 'KOTA B A T A M'
        WHEN 'NATION_4' THEN 'KOTA D U M A I' WHEN 'NATION_5' THEN 'KABUPATEN INDRAGIRI-HULU' WHEN 'NATION_6' THEN NULL
        WHEN 'NATION_7' THEN 'KABUPATEN ROKAN (HILIR)' WHEN 'NATION_8' THEN 'KEPULAUAN KABUPATEN'
        ELSE kabupaten END""",
    "rujukan": "CASE rujukan WHEN 'A' THEN 'Dalam' WHEN 'N' THEN 'Luar' ELSE 'Inisiatif Sendiri' END",
}


def _raw_sql(time_text: str, day_text: str, text: str) -> str:
    def column(name: str) -> str:
        kind = VISIT_SCHEMA[name].dataType.typeName()
        if name in _MESSY:
            return f"{_MESSY[name]} AS {name}"
        if kind == "timestamp_ntz":
            return f"{time_text.format(name)} AS {name}"
        if kind == "date":
            return f"{day_text.format(name)} AS {name}"
        return f"CAST({name} AS {text}) AS {name}"

    return f"SELECT {', '.join(column(n) for n in COLUMNS)} FROM "


SPARK_RAW = _raw_sql("date_format({}, 'yyyy-MM-dd HH:mm:ss')", "date_format({}, 'yyyy-MM-dd')", "STRING") + "{v}"
DUCKDB_RAW = _raw_sql("strftime({}, '%Y-%m-%d %H:%M:%S')", "strftime({}, '%Y-%m-%d')", "VARCHAR") + "visits"
RAW_CTE = f"raw AS ({DUCKDB_RAW})"


def raw_visits(v: DataFrame) -> DataFrame:
    return v.sparkSession.sql(SPARK_RAW, v=v)


#: Records of a file that is read by one task.
FILE_RECORDS = 100_000


def _write_csv(df: DataFrame, path: str, compression: str) -> None:
    writer = df.write.option("header", True).option("compression", compression)
    if compression == "gzip":
        writer = writer.option("maxRecordsPerFile", FILE_RECORDS)
    writer.csv(path)


def _json_texts(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def _joined(size: int):
    """Texts of a task's records -> JSON arrays of ``size`` records, in the order they come."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            full = len(held) - len(held) % size
            yield _text_batch(f"[{','.join(held[i : i + size])}]" for i in range(0, full, size))
            held = held[full:]
        if held:
            yield _text_batch([f"[{','.join(held)}]"])

    return arrays


def _bracketed(size: int):
    """Texts of a task's records -> the same, as lines of one JSON array for every ``size`` of them."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = 0, []  # the last record of a task closes its array, so one is held back
        for batch in batches:
            texts = held + batch.column(0).to_pylist()
            texts, held = texts[:-1], texts[-1:]
            yield _text_batch(_line(t, n, size, False) for n, t in enumerate(texts, done))
            done += len(texts)
        if held:
            yield _text_batch([_line(held[0], done, size, True)])

    return lines


def _line(text: str, number: int, size: int, last: bool) -> str:
    first, last = number % size == 0, last or number % size == size - 1
    return ("[\n" if first else "") + text + ("\n]" if last else ",")


def _text_batch(texts: Iterable[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string())], ["value"])


def _write_json_arrays(df: DataFrame, path: str, size: int = 500, per_file: int = 1_000_000) -> None:
    """Lines of JSON arrays of at most ``size`` records, as the polled source sends them.

    Every task writes its own records as they come, compressed: no shuffle, and nothing is gathered
    beyond one array. A file holds ``per_file`` records at most.
    """
    text = _json_texts(df).mapInArrow(_joined(size), "value string")
    text.write.option("maxRecordsPerFile", max(1, per_file // size)).option("compression", "gzip").text(path)


def _write_json_files(df: DataFrame, path: str, size: int = 50_000) -> None:
    """Files of one array of at most ``size`` records each, a record to a line; written as above."""
    text = _json_texts(df).mapInArrow(_bracketed(size), "value string")
    text.write.option("maxRecordsPerFile", size).option("compression", "gzip").text(path)


def _stored(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    with finer_shuffles(spark, base_length(spark, sf_dir)):
        path = stored_once(spark, sf_dir, name, lambda to: write(raw_visits(visits_once(spark, sf_dir)), to))
    if path is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return path


def csv_path(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    return _stored(spark, sf_dir, f"csv-{compression}", lambda d, to: _write_csv(d, to, compression))


def json_files_path(spark: SparkSession, sf_dir: str) -> str:
    return _stored(spark, sf_dir, "json-files", _write_json_files)


def json_path(spark: SparkSession, sf_dir: str) -> str:
    """Six files at least where there are so many arrays, however small the table; compressed, a file is read by one task."""
    lines = spark.read.parquet(table_path(sf_dir, "lineitem")).count()  # from the files' footers
    per_file = min(FILE_RECORDS, max(500, lines // 6))
    return _stored(spark, sf_dir, "json", lambda df, to: _write_json_arrays(df, to, per_file=per_file))


def json_share(spark: SparkSession, path: str, sixths: int) -> int:
    """How many of the folder's files are so many sixths of them."""
    found = [n for n in children(spark, path) if n.startswith("part-")]
    return max(1, math.ceil(len(found) * sixths / 6))


