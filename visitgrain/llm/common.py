"""Shared by the operators: reading columns safely, mapping Arrow batches, written intermediates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.sources.fs import new_folder

#: Rows handed to an operator at a time, so that what it makes of them stays small.
ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever else the frame holds.

    Other columns may repeat a name or differ from it in case only; they are left out. Where no
    column has the exact name, one that differs in case is taken.
    """
    have = df.columns
    lower = [c.lower() for c in have]
    places = [have.index(n) if n in have else lower.index(n.lower()) for n in names]
    numbered = df.toDF(*(f"c{i}" for i in range(len(have))))
    return numbered.select(*(F.col(f"c{i}").alias(n) for i, n in zip(places, names)))


def type_of(df: DataFrame, name: str) -> str:
    """A column's type as text, by exact name first."""
    have = df.columns
    place = have.index(name) if name in have else [c.lower() for c in have].index(name.lower())
    return df.schema.fields[place].dataType.simpleString()


def scan(
    docs: DataFrame,
    names: Sequence[str],
    start: Callable[[], Callable[..., dict]],
    out: dict[str, str],
    rows: int = ROWS,
) -> DataFrame:
    """Map the named columns through Python, some rows at a time.

    ``start()`` runs once in each task and returns a function from the columns (Arrow arrays) to a
    dict of output columns: a column passed on as it came, or (values, Arrow type). ``out`` has
    their SQL types. No row leaves its partition.
    """
    order = list(out)

    def column(made) -> pa.Array:
        return made if isinstance(made, pa.Array) else pa.array(made[0], made[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                made = work(*batch.slice(low, rows).columns)
                yield pa.RecordBatch.from_arrays([column(made[c]) for c in order], names=order)

    return pick(docs, *names).mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in out.items()))


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def settle(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write to the shared folder and read again: later steps neither recompute it nor lose it
    with an executor."""
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
