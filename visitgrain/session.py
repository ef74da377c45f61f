"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app: str = "visitgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for.

    Sizes that depend on the cluster (executor memory, shuffle partitions) are left to the
    caller; adaptive execution coalesces and splits shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """One-machine session for tests and benches."""
    parallel = "8" if cores == "*" else str(cores)
    return build_session(
        master=f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": parallel,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.memory": "16g",
            **conf,
        },
    )


def shared_dir(spark: SparkSession) -> str | None:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent a local master gets a temporary folder; on a cluster there is
    no safe default, so the answer is None and callers keep their plan lazy instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        return None
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="visitgrain-")
    return _local_dirs[app]


def require_shared_dir(spark: SparkSession) -> str:
    folder = shared_dir(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_TARGET = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCAN = "spark.sql.files.maxPartitionBytes"
#: Bytes of compressed columnar input for each partition that a shuffle begins with.
FINE_BYTES = 2_000_000
#: Bytes of shuffled rows that adaptive execution joins to one partition at most; in memory they are some ten times that.
FINE_TARGET = 32 << 20
#: Bytes of files that a task reads at most. Its rows wait in memory to be dealt, some twenty times as large as in compressed
#: columns; a file's own row groups are not split.
FINE_SCAN = 24 << 20


@contextmanager
def finer_shuffles(spark: SparkSession, size: int, target: int = FINE_TARGET) -> Iterator[None]:
    """Shuffles of what runs inside begin with partitions in proportion to ``size``, the input's bytes.

    A sort of whole rows spills where the session's number of partitions stays as it was while the
    input grows. Adaptive execution joins small partitions again, up to its target, ``target`` bytes at most. Files are read in
    parts of a bounded size, for a task that deals what it reads spills as well. Shuffle files go
    when their query has ended, and not when the driver's garbage collector comes to them: a load of
    many writes holds those of one write on disk.
    """
    before = {k: spark.conf.get(k, None) for k in (_INITIAL, _TARGET, _FREED, _SCAN)}
    fewest = int(before[_INITIAL] or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_INITIAL, str(max(fewest, -(-size // FINE_BYTES))))
    spark.conf.set(_TARGET, str(min(_bytes(before[_TARGET] or "64m"), target)))
    spark.conf.set(_FREED, "true")
    spark.conf.set(_SCAN, str(min(_bytes(before[_SCAN] or "128m"), FINE_SCAN)))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _bytes(text: str) -> int:
    """A size as Spark's settings write it: ``64m``, ``64MB``, ``67108864b``, ``67108864``."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
