"""Token totals by source, language and tokenizer version, kept up by signed batches.

A ledger is a folder. A batch of signed rows (+1 for a document that comes, -1 for one that goes;
a revised count is both) is added up and written under its own name. Totals are sums of committed
batches, so the order of batches doesn't matter and nothing is rewritten. A batch is committed when
its write job has finished; committing the same totals under its name again changes nothing, other totals
are refused, and a broken attempt is written anew. ``compact`` folds committed batches into one snapshot that lists what it holds, and
batches listed there are not added twice.

Counts are those of the named byte-pair vocabularies. Defined results: null and empty texts have no
tokens; a null source or language is a group of its own; repeated rows count each; groups whose
totals are all zero are left out; an empty table gives no group; other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitgrain.llm.common import scan, texts_of, type_of
from visitgrain.sources.fs import exists, finished, is_written

KEYS = ("source", "lang", "tokenizer")
_BATCH = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
_TOTALS = f"{_BATCH}, batches array<string>"


@lru_cache(4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(
    docs: DataFrame,
    versions: dict[str, str],
    pattern: str,
    keep: tuple[str, ...],
    wanted: Column | None = None,
    text_col: str = "text",
) -> DataFrame:
    """``keep`` columns and ``counts``, a map from tokenizer version to the text's number of tokens.

    ``versions`` names rank files, installed at the same place on every executor; ``wanted`` is an
    array of the versions a row is counted under (all without it), so several need one pass.
    """
    docs = docs.withColumn("versions wanted", F.array(*map(F.lit, versions)) if wanted is None else wanted)

    def start():
        def count(text: str, names: list[str]) -> list[tuple[str, int]]:
            return [
                (n, len(_encoding(versions[n], pattern).encode_ordinary(text)) if text else 0) for n in names or ()
            ]

        def work(texts, names, *rest):
            counts = [count(t, n) for t, n in zip(texts_of(texts), names.to_pylist())]
            return {"counts": (counts, pa.map_(pa.string(), pa.int64())), **dict(zip(keep, rest))}

        return work

    out = {c: type_of(docs, c) for c in keep} | {"counts": "map<string, bigint>"}
    return scan(docs, [text_col, "versions wanted", *keep], start, out)


def signed(counted: DataFrame, sign: int, tokenizer: str) -> DataFrame:
    """Delta rows of documents counted under ``tokenizer``."""
    return counted.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("bigint").alias("n_docs"),
        (F.col("counts")[tokenizer] * sign).cast("bigint").alias("n_tokens"),
    )


class Ledger:
    """Totals in ``folder``, which must be shared by the executors."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, batch: str) -> str:
        return f"{self.folder}/batches/{batch}"

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if it was committed before, an error if it was with other totals."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        totals = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        if is_written(self.spark, self._place(batch)):
            before = self.spark.read.schema(_BATCH).parquet(self._place(batch))
            changed = totals.exceptAll(before).unionAll(before.exceptAll(totals))
            if not changed.isEmpty():
                raise ValueError(f"batch {batch} was committed with other totals; send the difference under a new name")
            return False
        if batch in self._folded():
            return False
        totals.write.mode("overwrite").parquet(self._place(batch))
        return True

    def _snapshots(self) -> list[str]:
        return finished(self.spark, f"{self.folder}/snapshots/*") if exists(self.spark, f"{self.folder}/snapshots") else []

    def _folded(self) -> set[str]:
        found = self._snapshots()
        if not found:
            return set()
        listed = self.spark.read.schema(_TOTALS).parquet(found[-1]).where("batches is not null").select("batches").first()
        return set(listed[0]) if listed else set()

    def batches(self) -> list[str]:
        """Committed batches, by name."""
        written = finished(self.spark, self._place("*"))
        return sorted({p.rsplit("/", 1)[1] for p in written} | self._folded())

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs``, ``n_tokens`` over all committed batches."""
        folded = self._folded()
        paths = [p for p in finished(self.spark, self._place("*")) if p.rsplit("/", 1)[1] not in folded]
        rows = self.spark.createDataFrame([], _BATCH)
        if paths:
            rows = self.spark.read.schema(_BATCH).parquet(*paths)
        if folded:
            snapshot = self.spark.read.schema(_TOTALS).parquet(self._snapshots()[-1])
            rows = rows.unionByName(snapshot.where("batches is null").drop("batches"))
        return (
            rows.groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs != 0 OR n_tokens != 0")
        )

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; it counts once its write has finished."""
        names, number = self.batches(), len(self._snapshots())
        listing = self.spark.createDataFrame([(names,)], "batches array<string>")
        rows = self.totals().withColumn("batches", F.lit(None).cast("array<string>"))
        rows.unionByName(listing, allowMissingColumns=True).write.mode("overwrite").parquet(
            f"{self.folder}/snapshots/{number:09d}"
        )
