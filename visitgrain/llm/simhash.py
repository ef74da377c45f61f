"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

``fingerprints``: 64 bits from the XXH64 values of a text's word shingles, each bit by majority.

``near_pairs``: fingerprints within ``radius`` differing bits of each other. The 64 bits are cut
into ``segments``. If two fingerprints differ in at most ``radius`` bits, then in one of the first
``radius % segments + 1`` segments they differ in at most ``radius // segments`` bits, or in one of
the others in at most one bit fewer. Each fingerprint stands in a table under every segment's own
value; it asks that table for every value in the small Hamming ball around each segment, and the
complete distance is verified in the join. Of two fingerprints only the one whose lowest differing
bit is 0 asks, so a pair is met once from each segment that can find it.

A segment value that more than ``crowd`` fingerprints share would make pairs by the square. Those
who ask for such a value look up whole fingerprints instead: every one that differs, in the other
bits, by what is left of the radius. A whole fingerprint stands in the table once, so the work for
a fingerprint is bounded by the size of the ball whatever the data, and no pair is lost.

``components``: the smallest document id that can be reached over links, found by alternating
large-star and small-star steps on written tables.

Defined results: a null or empty text has fingerprint zero, linked like any other; repeated rows
get the same answer; a null id never names a component, so a component without any id has null;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.llm.common import pick, scan, settle, texts_of, type_of

SEED = 42
BITS = 64


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included.

    Letters A-Z are lower-cased; words are what stands between ASCII white space. A text of fewer
    words is one shingle; one without words has none.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = ends.cumsum()
    starts = [0, *ends[:-width].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes as an unsigned number."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for low in range(0, n, 1 << 16):
        octets = hashes[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``fp``, the fingerprint as a signed 64-bit number."""

    def start():
        def work(ids, texts):
            made = np.array([fingerprint(t, width) for t in texts_of(texts)], np.uint64).view(np.int64)
            return {id_col: ids, "fp": (made, pa.int64())}

        return work

    return scan(docs, [id_col, text_col], start, {id_col: type_of(docs, id_col), "fp": "bigint"})


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(places: list[int], most: int) -> list[tuple[int, int]]:
    """(mask, number of its bits) over the given bit places, up to ``most`` bits."""
    return [(sum(1 << p for p in chosen), n) for n in range(most + 1) for chosen in combinations(places, n)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _ball(masks: list[tuple[int, int]]) -> F.Column:
    """Array of (mask, its bits, its lowest bit)."""
    rows = ", ".join(f"({_signed(m)}L, {n}, {_signed(m & -m)}L)" for m, n in masks)
    rows = rows.replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
    return F.expr(f"transform(array({rows}), x -> named_struct('mask', x.col1, 'bits', x.col2, 'lowest', x.col3))")


def segments_for(count: int, radius: int) -> int:
    """Segments whose values are about as many as the fingerprints, so that a look-up meets few.

    The pairs found are the same for any number of segments.
    """
    return min(radius + 1, max(2, round(BITS / log2(max(count, 2)))))


def near_pairs(
    nodes: DataFrame, spark: SparkSession, radius: int = 2, segments: int = 2, crowd: int | None = None
) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column ``fp`` of ``nodes``, each pair once."""
    cuts = _cuts(segments)
    base, extra = divmod(radius, segments)
    reach = [base if i <= extra else base - 1 for i in range(segments)]
    if crowd is None:
        # Beyond this size looking up whole fingerprints costs less than comparing the bucket.
        crowd = 2 * sum(comb(BITS - cuts[0][1], k) for k in range(radius + 1))

    def key(shift: int, width: int, fp: str = "fp") -> F.Column:
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    used = [(i, *cuts[i]) for i in range(segments) if reach[i] >= 0]
    table = nodes.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), key(s, w).alias("key")) for i, s, w in used))).alias("e")
    ).select("fp", "e.seg", "e.key")
    asking = None
    for i, shift, width in used:
        part = (
            nodes.select("fp", key(shift, width).alias("own"), F.explode(_ball(_masks(list(range(width)), reach[i]))).alias("m"))
            .where("own & m.lowest = 0")
            .select("fp", F.lit(i).alias("seg"), (F.col("own").bitwiseXOR(F.col("m.mask"))).alias("key"), F.col("m.bits").alias("bits"))
        )
        asking = part if asking is None else asking.unionByName(part)
    crowded = settle(table.groupBy("seg", "key").count().where(F.col("count") > crowd).select("seg", "key"), spark, "crowded")
    any_crowded = not crowded.isEmpty()

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    def close(x: str, y: str) -> F.Column:
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius

    plain_table = table.join(crowded, ["seg", "key"], "left_anti") if any_crowded else table
    other = plain_table.select(F.col("fp").alias("other"), F.col("seg").alias("s"), F.col("key").alias("k"))
    met = asking.join(
        other,
        (F.col("seg") == F.col("s"))
        & (F.col("key") == F.col("k"))
        & ((F.col("bits") > 0) | (F.col("fp") < F.col("other")))
        & close("fp", "other"),
    )
    pairs = ordered(met)
    if any_crowded:
        whole = nodes.select(F.col("fp").alias("other"))
        asked = asking.join(crowded, ["seg", "key"], "left_semi")
        for i, shift, width in used:
            outside = [p for p in range(BITS) if not shift <= p < shift + width]
            mine = asked.where(F.col("seg") == i)
            probes = (
                mine.select("fp", "key", "bits", F.explode(_ball(_masks(outside, radius))).alias("m"))
                .where((F.col("m.bits") + F.col("bits") <= radius) & (F.col("m.bits") + F.col("bits") > 0))
                .where((F.col("bits") > 0) | (F.col("fp").bitwiseAND(F.col("m.lowest")) == 0))
                .select(
                    "fp",
                    F.col("fp")
                    .bitwiseXOR(F.shiftleft(key(shift, width).bitwiseXOR(F.col("key")), shift))
                    .bitwiseXOR(F.col("m.mask"))
                    .alias("target"),
                )
            )
            pairs = pairs.unionByName(ordered(probes.join(whole, F.col("target") == F.col("other")).select("fp", "other")))
    return pairs.distinct()


def components(pairs: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a, b): root is the smallest node reachable.

    Each round joins every node to the smallest in its neighbourhood: large-star for greater
    neighbours, small-star for the others. Rounds end when no edge changes; their number grows
    with the logarithm of the longest path. A node of very many neighbours is met as the key of a
    minimum, which is combined before the shuffle, and of a join of two written tables, which
    adaptive execution splits where a key is hot.
    """
    edges = settle(pairs.select("a", "b").where("a != b").distinct(), spark, "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = settle(least, spark, "least")
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        large = settle(large, spark, "edges")
        down = large.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        lowest = settle(down.groupBy("x").agg(F.min("y").alias("m")), spark, "least")
        small = (
            down.join(lowest, "x")
            .select(F.col("m").alias("a"), F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("b"))
            .where("a != b")
            .distinct()
        )
        edges = settle(small, spark, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def groups(
    docs: DataFrame,
    spark: SparkSession,
    width: int = 3,
    radius: int = 2,
    segments: int | None = None,
    crowd: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Each row's (id, ``fp``), and each distinct fingerprint's ``root`` and ``component_id``."""
    marked = settle(fingerprints(docs, width, id_col, text_col), spark, "fingerprints")
    nodes = settle(marked.groupBy("fp").agg(F.min(id_col).alias("rep")), spark, "nodes")
    if segments is None:
        segments = segments_for(nodes.count(), radius)
    pairs = near_pairs(nodes, spark, radius, segments, crowd)
    roots = components(pairs, spark)
    # Ids are compared over each component, since its smallest fingerprint need not hold the smallest id.
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("of"), "rep", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marked, rooted.drop("rep").join(named, "root")


def near_duplicates(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``; ``how`` goes to ``groups``."""
    marked, answer = groups(docs, spark, id_col=id_col, **how)
    return marked.join(answer, F.col("fp") == F.col("of")).select(id_col, "fp", "component_id")

