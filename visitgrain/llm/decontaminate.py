"""Benchmark decontamination: short test items found inside long documents.

Containment of an item in a document is the share of the item's distinct word shingles that the
document has. The search is by MinHash of the smaller set, partitioned by size:

* an item's signature is the least hash values of its shingles (bottom-k). Items fall into size
  classes by powers of two; k follows from the class and the threshold: it is one more than the
  number of shingles that an item of the class can miss and still reach the threshold. So a
  document that contains the item has at least one hash of the signature, and the candidate step
  loses nothing, however long the document is. (Banded MinHash of the document would need
  thousands of permutations where an item is a thousandth of the document.)
* a document with fewer shingles than the threshold asks of the least item of a class is not
  compared with that class.

Candidates are verified by exact containment on the shingles' words. Shingle hashes of a document
are made from the hashes of its words by one rolling sum over the whole text, so a document is read
once, in its own partition, and no text is shuffled.

The benchmark is held by tasks in blocks of at most ``BLOCK`` shingles; a larger benchmark is
searched in several passes over the documents.

Words are runs of letters and digits in lower case, so punctuation, case and white space don't
matter. Defined results: a null or empty item has no shingles and is found nowhere; an item of
fewer words than a shingle is one shingle of all its words and must occur as such; a null or empty
document contains nothing; repeated rows are searched each for itself; repeated benchmark rows are
one item when id and text are equal; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.llm.common import pick, scan, settle, texts_of, type_of

WIDTH = 5
LEAST = 0.8
#: Shingles of benchmark items held by a task at a time.
BLOCK = 1 << 19
#: Words whose hashes a Python worker keeps.
KEPT = 1 << 18

_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles_of(words: list[str], width: int) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


class WordHashes(dict):
    """Hash of a word, kept until there are too many."""

    def __missing__(self, word: str) -> int:
        made = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self) >= KEPT:
            self.clear()
        self[word] = made
        return made


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; of all words where there are fewer."""
    width = min(width, len(hashes))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _STEP
        out += hashes[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Signatures:
    """Signature hashes of the items whose shingles have the same number of words."""

    def __init__(self):
        self.of: dict[int, set[int]] = defaultdict(set)

    def seal(self) -> "Signatures":
        self.hashes = np.array(sorted(self.of), np.uint64)
        # A table over the leading bits settles most look-ups.
        self.leading = np.zeros(1 << 20, bool)
        self.leading[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        return self

    def met(self, runs: np.ndarray) -> set[int]:
        """Items with a signature hash among ``runs``."""
        maybe = runs[self.leading[(runs >> np.uint64(44)).astype(np.int64)]]
        if not len(maybe):
            return set()
        at = np.minimum(np.searchsorted(self.hashes, maybe), len(self.hashes) - 1)
        return {k for h in set(maybe[self.hashes[at] == maybe].tolist()) for k in self.of[h]}


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], width: int = WIDTH, least: float = LEAST):
        self.least = least
        self.items: list[tuple[object, int, set]] = []
        self.signatures: dict[int, Signatures] = defaultdict(Signatures)
        known = WordHashes()
        for name, text in items:
            words = words_of(text)
            shingles = shingles_of(words, width)
            if not shingles:
                continue
            size, own = len(shingles), min(width, len(words))
            top = 1 << (size - 1).bit_length()  # greatest size of the item's class
            missed = top - ceil(least * top - 1e-9)
            hashes = np.unique(rolling(np.array([known[w] for w in words], np.uint64), own))
            for h in hashes[: missed + 1].tolist():
                self.signatures[own].of[h].add(len(self.items))
            self.items.append((name, size, shingles))
        for s in self.signatures.values():
            s.seal()

    def found_in(self, text: str, known: WordHashes) -> list[tuple[object, int, int]]:
        """(item, its shingles in the text, its shingles) for each item contained in the text."""
        words = words_of(text)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out = []
        for own, signatures in self.signatures.items():
            if own > len(words):
                continue
            runs = rolling(hashes, own)
            near = [k for k in sorted(signatures.met(runs)) if len(runs) >= self.least * self.items[k][1] - 1e-9]
            if near:
                there = shingles_of(words, own)
                for name, size, shingles in map(self.items.__getitem__, near):
                    shared = len(shingles & there)
                    if shared >= self.least * size - 1e-9:
                        out.append((name, shared, size))
        return out


def _blocks(
    benchmark: DataFrame, spark: SparkSession, id_col: str, text_col: str, block: int
) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about ``block`` words at most, each brought to the driver alone."""
    items = (
        pick(benchmark, id_col, text_col)
        .where(F.col(text_col).isNotNull())
        .distinct()
        .withColumn("size", F.size(F.split(text_col, r"[^\p{L}\p{N}]+")))
    )
    total = items.agg(F.sum("size")).first()[0] or 0
    if total <= block:
        yield [(r[0], r[1]) for r in items.select(id_col, text_col).collect()]
        return
    count = ceil(2 * total / block)
    dealt = settle(items.withColumn("deal", F.pmod(F.xxhash64(id_col, text_col), F.lit(count))), spark, "items")
    for k in range(count):
        yield [(r[0], r[1]) for r in dealt.where(F.col("deal") == k).select(id_col, text_col).collect()]


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    spark: SparkSession,
    width: int = WIDTH,
    least: float = LEAST,
    block: int = BLOCK,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and item contained in it: both ids, ``shared`` and ``size`` (shingles)."""
    kind = pa.list_(pa.struct([("item", pa.string()), ("shared", pa.int64()), ("size", pa.int64())]))

    def search(items: list[tuple[object, str]]) -> DataFrame:
        def start():
            known, held = WordHashes(), Items(items, width, least)

            def work(ids, texts):
                found = [
                    [{"item": str(n), "shared": shared, "size": size} for n, shared, size in held.found_in(t, known)]
                    for t in texts_of(texts)
                ]
                return {id_col: ids, "items": (found, kind)}

            return work

        out = {id_col: type_of(docs, id_col), "items": "array<struct<item: string, shared: bigint, size: bigint>>"}
        return (
            scan(docs, [id_col, text_col], start, out)
            .select(F.col(id_col), F.explode("items").alias("i"))
            .select(id_col, F.col("i.item").cast(type_of(benchmark, item_col)).alias(item_col), "i.shared", "i.size")
        )

    made: DataFrame | None = None
    blocks = with_alone(_blocks(benchmark, spark, item_col, text_col, block))
    for items, alone in blocks:
        rows = search(items) if alone else settle(search(items), spark, "found")
        made = rows if made is None else made.unionByName(rows)
    return made


def with_alone(blocks: Iterator) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the only one."""
    first = next(blocks)
    second = next(blocks, None)
    yield first, second is None
    while second is not None:
        yield second, False
        second = next(blocks, None)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    spark: SparkSession,
    keep: tuple[str, ...],
    width: int = WIDTH,
    least: float = LEAST,
    block: int = BLOCK,
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``keep`` columns of the documents that contain no item.

    Each block of items is one pass over what the pass before has left.
    """
    others = [c for c in keep if c != text_col]

    def passed(df: DataFrame, items: list[tuple[object, str]]) -> DataFrame:
        def start():
            known, held = WordHashes(), Items(items, width, least)

            def work(texts, *rest):
                clean = pa.array([not held.found_in(t, known) for t in texts_of(texts)], pa.bool_())
                return {c: v.filter(clean) for c, v in zip([text_col, *others], [texts, *rest])}

            return work

        return scan(df, [text_col, *others], start, {c: type_of(df, c) for c in [text_col, *others]})

    for items, alone in with_alone(_blocks(benchmark, spark, item_col, text_col, block)):
        docs = passed(docs, items)
        docs = docs if alone else settle(docs, spark, "passed")
    return docs.select(*keep)
