"""The stored visits table kept up with its base tables, file by file.

``extend`` takes in the files that came since the last time and appends the visits they make:
new line items with all orders, and earlier line items with new orders, since either may come
first. The other sides are read only between the least and greatest key of what is new. Months that
nothing new falls into keep their files. A file that changed or went, or a new file of a
dimension, may alter rows that stand already: then the table is built anew beside the old one.

A table is a folder of generations, each a stored visits table with a list of the files in it.
The list is a table of its own and is compared by a join. An extension announces itself before it writes. If it broke off, the next one
leaves out the keys that the table holds by then, so nothing is added twice. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.operators.clean import drop_known
from visitgrain.sources.fs import delete, finished, hadoop_path
from visitgrain.sources.tables import read_stored_visits, write_visits
from visitgrain.sources.visits import STAR_TABLES, VISITS_SQL, table_path

#: Tables whose new files only add visits.
FACTS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
FILE = ("base", "path", "modified", "length")
_FILES = "base string, path string, modified timestamp, length bigint"
KEPT_GENERATIONS = 2


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base``, ``path``, ``modified``, ``length`` of all files of the base tables; contents are not read."""

    def of(base: str) -> DataFrame:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(table_path(sf_dir, base))
        return listed.select(
            F.lit(base).alias("base"), "path", F.col("modificationTime").alias("modified"), "length"
        )

    return reduce(DataFrame.unionByName, map(of, STAR_TABLES))


def _generations(spark: SparkSession, target: str) -> list[str]:
    """Generations that have a list of files, oldest first."""
    return sorted({p.split("/files/")[0] for p in finished(spark, f"{target}/g*/files/*")})


def _lists(spark: SparkSession, generation: str) -> list[str]:
    return finished(spark, f"{generation}/files/*")


def _taken(spark: SparkSession, generation: str) -> DataFrame:
    return spark.read.schema(_FILES).parquet(*_lists(spark, generation))


def current(spark: SparkSession, target: str) -> DataFrame:
    """The visits of the newest generation."""
    found = _generations(spark, target)
    if not found:
        raise FileNotFoundError(f"no visits table at {target}")
    return read_stored_visits(spark, f"{found[-1]}/visits")


def _between(frame: DataFrame, key: str, of: DataFrame, other: str) -> DataFrame:
    """Rows whose key lies within the span of the other side's keys; a span of statistics, not a join."""
    low, high = (of.agg(f(other).alias("k")).scalar() for f in (F.min, F.max))
    return frame.where((F.col(key) >= low) & (F.col(key) <= high))


def _paths(files: DataFrame) -> dict[str, list[str]]:
    """Names by base table: what Spark's own listing of a table holds on the driver as well."""
    out: dict[str, list[str]] = {}
    for base, path in files.select("base", "path").collect():
        out.setdefault(base, []).append(path)
    return out


def _read(spark: SparkSession, sf_dir: str, base: str, paths: list[str]) -> DataFrame:
    """Exactly the given files of a base table, with its schema."""
    place = table_path(sf_dir, base)
    jpath, fs = hadoop_path(spark, place)
    reader = spark.read.schema(spark.read.parquet(place).schema)
    if fs.getFileStatus(jpath).isDirectory():
        reader = reader.option("basePath", place)
    return reader.parquet(*paths)


def new_visits(spark: SparkSession, sf_dir: str, taken: DataFrame, come: DataFrame) -> DataFrame:
    """The visits that exist since the fact files ``come`` joined the files ``taken``.

    Only listed files are read: one that arrives meanwhile waits for the next extension.
    """
    old, new = _paths(taken), _paths(come)
    whole = {t: _read(spark, sf_dir, t, old.get(t, []) + new.get(t, [])) for t in STAR_TABLES}
    parts = []
    if "lineitem" in new:
        lines = _read(spark, sf_dir, "lineitem", new["lineitem"])
        orders = _between(whole["orders"], "o_orderkey", lines, "l_orderkey")
        parts.append(spark.sql(VISITS_SQL, **{**whole, "lineitem": lines, "orders": orders}))
    if "orders" in new and "lineitem" in old:  # new lines have met all orders above
        orders = _read(spark, sf_dir, "orders", new["orders"])
        lines = _between(_read(spark, sf_dir, "lineitem", old["lineitem"]), "l_orderkey", orders, "o_orderkey")
        parts.append(spark.sql(VISITS_SQL, **{**whole, "lineitem": lines, "orders": orders}))
    return reduce(DataFrame.unionByName, parts)


def extend(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    """Bring the visits table at ``target`` up to its base tables and return it."""
    now = base_files(spark, sf_dir)
    found = _generations(spark, target)
    if not found:
        return _build(spark, sf_dir, target, now)
    generation = found[-1]
    taken = _taken(spark, generation)
    come = now.join(taken, list(FILE), "left_anti").persist()
    try:
        kinds = {r[0] for r in come.select("base").distinct().collect()}  # six names at most
        gone = not taken.join(now, list(FILE), "left_anti").isEmpty()
        if gone or kinds - FACTS.keys():
            return _build(spark, sf_dir, target, now)
        if kinds:
            _append(spark, sf_dir, generation, come)
    finally:
        come.unpersist()
    return current(spark, target)


def _build(spark: SparkSession, sf_dir: str, target: str, now: DataFrame) -> DataFrame:
    found = _generations(spark, target)
    number = int(found[-1].rsplit("/g", 1)[1][:8]) + 1 if found else 1
    generation = f"{target}/g{number:08d}-{uuid.uuid4().hex[:8]}"
    # Listed once, and only listed files are read: one that arrives meanwhile is the next extension's.
    now.coalesce(1).write.parquet(f"{generation}/listed")
    listed = spark.read.schema(_FILES).parquet(f"{generation}/listed")
    read = {t: _read(spark, sf_dir, t, paths) for t, paths in _paths(listed).items()}
    write_visits(spark.sql(VISITS_SQL, **read), f"{generation}/visits", mode="error")
    listed.coalesce(1).write.parquet(f"{generation}/files/00000000")
    for old in found[: 1 - KEPT_GENERATIONS]:
        delete(spark, old)
    return current(spark, target)


def _append(spark: SparkSession, sf_dir: str, generation: str, come: DataFrame) -> None:
    number = len(_lists(spark, generation))
    started, path = f"{generation}/started/{number:08d}", f"{generation}/visits"
    broken = bool(finished(spark, started))
    if not broken:
        come.coalesce(1).write.parquet(started, mode="overwrite")
    rows = new_visits(spark, sf_dir, _taken(spark, generation), come)
    if broken:
        rows = drop_known(rows, read_stored_visits(spark, path))
    write_visits(rows, path, mode="append")
    come.coalesce(1).write.parquet(f"{generation}/files/{number:08d}", mode="overwrite")
