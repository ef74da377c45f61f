"""Small questions to the file system a path lives on."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession

from visitgrain.session import require_shared_dir


def hadoop_path(spark: SparkSession, path: str):
    """A path object and the file system holding it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = hadoop_path(spark, path)
    return fs.exists(jpath)


def is_written(spark: SparkSession, path: str) -> bool:
    """True for a folder whose write job finished."""
    return exists(spark, f"{path}/_SUCCESS")


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """Completely written folders matching a glob, sorted."""
    jpath, fs = hadoop_path(spark, f"{pattern}/_SUCCESS")
    return sorted(s.getPath().getParent().toString() for s in fs.globStatus(jpath) or [])


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no such folder."""
    jpath, fs = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    jpath, fs = hadoop_path(spark, path)
    fs.delete(jpath, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{require_shared_dir(spark)}/visitgrain-{name}-{uuid.uuid4().hex[:12]}"


#: How much larger plain text is than the same rows in compressed columns, about.
TEXT_FACTOR = 10


def read_bytes(frame: DataFrame) -> int:
    """Bytes of the files that a frame reads, plain text as if it were compressed columns; 0 for
    frames that read none, such as cached ones and batches of a stream."""
    folders: dict[str, set[str]] = {}
    for path in set(frame.inputFiles()):
        folder, name = path.rsplit("/", 1)
        folders.setdefault(folder, set()).add(name)
    total = 0
    for folder, names in folders.items():
        jpath, fs = hadoop_path(frame.sparkSession, unquote(folder))  # names come as they stand in URIs
        for status in fs.listStatus(jpath):
            name = status.getPath().getName()
            if quote(name) in names or name in names:
                total += status.getLen() // (TEXT_FACTOR if name.endswith((".csv", ".json", ".txt")) else 1)
    return total
