"""Incrementally maintained daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from visitgrain.sources.fs import delete, finished
from visitgrain.streaming.landing import start

WINDOW = "time_period"
#: The live series is kept in spans of so many seconds, 31 days, counted from the epoch in any time zone.
SPAN = 31 * 86_400
_LIST = T.StructType([T.StructField("span", T.LongType()), T.StructField("batch", T.LongType())])


def windowed(
    stream: DataFrame, ts: str, by: Sequence[str], measure: str, delay: str, width: str = "1 day"
) -> DataFrame:
    """Count and sum per window and key; works on a stream and on a batch frame."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by)
    sums = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))
    return sums.select(F.col("w.start").alias(WINDOW), *by, "n", "total")


def append_closed(series: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write each window once, after the watermark has passed its end."""
    writer = series.writeStream.outputMode("append").format("parquet").option("path", target)
    return start(writer, checkpoint, every)


def _with_span(rows: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(F.col(WINDOW).cast("timestamp"))
    return rows.withColumn("span", F.floor(seconds / SPAN).cast("long"))


def _lists(spark: SparkSession, target: str) -> list[str]:
    return finished(spark, f"{target}/lists/v*")


def _places(spark: SparkSession, path: str) -> dict[int, int]:
    """Span -> the batch that wrote it last; a row per 31 days of history."""
    return dict(map(tuple, spark.read.schema(_LIST).parquet(path).collect()))


def _read(spark: SparkSession, target: str, places: dict[int, int], schema: T.StructType) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    paths = [f"{target}/data/batch={b}/span={s}" for s, b in sorted(places.items())]
    return spark.read.schema(schema).parquet(*paths)


def upsert(changed: DataFrame, batch_id: int, target: str, keys: Sequence[str]) -> None:
    """Replace the changed keys in the aggregate: spans they lie in are written anew, others stay.

    A list names the batch that holds each span and is written last, so a reader sees the state before
    or after the batch; lists of later batches are ignored, which makes a replay harmless. The
    newest two lists are kept, and what they name. ``keys`` include the window.
    """
    spark, number = changed.sparkSession, f"v{batch_id:012d}"
    changed = changed.persist()  # a batch of a stream is computed anew for each use
    try:
        spans = {r[0] for r in _with_span(changed).select("span").distinct().collect()}
        if not spans:
            return
        before = [p for p in _lists(spark, target) if p.rsplit("/", 1)[1] < number]
        places = _places(spark, before[-1]) if before else {}
        old = _read(spark, target, {s: b for s, b in places.items() if s in spans}, changed.schema)
        rows = old.join(changed.select(*keys), list(keys), "left_anti").select(*changed.columns).unionByName(changed)
        written = _with_span(rows).hint("rebalance", "span").write.partitionBy("span")
        written.option("partitionOverwriteMode", "static").parquet(f"{target}/data/batch={batch_id}", mode="overwrite")
    finally:
        changed.unpersist()
    made = places | {s: batch_id for s in spans}
    spark.createDataFrame(sorted(made.items()), _LIST).coalesce(1).write.parquet(f"{target}/lists/{number}", mode="overwrite")
    # Readers hold the newest list or the one before; a replay of this batch starts from the latter.
    kept = set(made.items()) | set(places.items())
    for path in before[:-1]:
        for span, batch in set(_places(spark, path).items()) - kept:
            delete(spark, f"{target}/data/batch={batch}/span={span}")
        delete(spark, path)


def upsert_live(
    series: DataFrame, target: str, checkpoint: str, keys: Sequence[str], every: str | None = None
) -> StreamingQuery:
    """Keep open windows visible: every batch merges the windows it changed."""

    def sink(changed: DataFrame, batch_id: int) -> None:
        upsert(changed, batch_id, target, keys)

    return start(series.writeStream.outputMode("update").foreachBatch(sink), checkpoint, every)


def read_live(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The newest complete state; empty before the first."""
    done = _lists(spark, target)
    return _read(spark, target, _places(spark, done[-1]) if done else {}, schema)
