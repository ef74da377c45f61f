"""Groups of documents whose sets of word shingles have a Jaccard similarity of ``least`` or more.

A node is a distinct set of shingles, named by the XXH64 of its sorted members: texts of one set are
alike without a comparison, texts of different sets are linked only after an exact one.

Sets that may be alike meet in buckets, from two sources that are united. SimHash: one bucket for
each fingerprint of several sets and one for each pair of fingerprints within ``radius`` bits, by multi-index look-ups;
a fingerprint is made of the set, in which a repeated line counts once. Bands: ``BANDS`` buckets from as many
bands of ``ROWS_EACH`` minima, each under a permutation of its own: two sets of similarity s share one with
probability 1 - (1 - s ** 6) ** 50, which is 1 - 2.5e-7 at 0.8.

Groups are links followed to their end, so two sets of a bucket need no comparison once they are in
one group. Rounds compare the leader of each bucket with its others, as rows of a join: at most one for each
member. The leader is the set that meets most others in all its buckets, so that the origin of
many copies leads them even where the copies are unlike each other; it leaves its buckets afterwards. Rounds go on
while they shrink what stands apart by ``SHRINK``. What is left is compared all with all, exactly, but inside tasks: a bucket
is split into parts of at most about ``PART`` sets and ``PART_SHINGLES`` shingles, each two parts meet in one task, and
only the links leave it. There, pairs are first dropped whose sizes, less the shingles that no other set of the
two parts has, can't reach the similarity.

Defined results: null and empty texts are one text without shingles, alike to each other only; a
null id stands behind every other; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitgrain.llm import simhash
from visitgrain.llm.common import pick, scan, settle, texts_of, type_of

BANDS, ROWS_EACH = 50, 6
#: Another round follows if one left at most this share of the rows before it, and after the first.
SHRINK = 0.7
PART, PART_SHINGLES = 512, 1 << 18
#: Copies of one text are dealt to so many tasks where texts are looked up by their hash.
SALTS = 32

_RNG = np.random.default_rng(simhash.SEED)
_TIMES = (_RNG.integers(0, 1 << 31, BANDS * ROWS_EACH, np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS_EACH, np.uint32)[:, None]


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, width))


def name_of(shingles: np.ndarray) -> int:
    """The node of a set, as a signed number."""
    return simhash._signed(xxhash.xxh64_intdigest(shingles.tobytes(), simhash.SEED))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """The buckets of a set; none without shingles."""
    if not len(shingles):
        return np.empty(0, np.int64)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS_EACH, np.iinfo(np.uint32).max, np.uint32)
    for low in range(0, len(short), 512):
        np.minimum(least, (short[None, low : low + 512] * _TIMES + _PLUS).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS_EACH)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _marked(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, ``th`` (its text's hash), ``node``, ``size``, ``fp`` and ``bands``."""

    def start():
        def work(ids, hashes, texts):
            words = texts_of(texts)
            sets = [shingle_set(t, width) for t in words]
            prints = np.array([simhash.fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            return {
                id_col: ids,
                "th": hashes,
                "node": ([name_of(s) for s in sets], pa.int64()),
                "size": ([len(s) for s in sets], pa.int64()),
                "fp": (prints, pa.int64()),
                "bands": ([bands_of(s) for s in sets], pa.list_(pa.int64())),
            }

        return work

    out = {id_col: type_of(docs, id_col), "th": "bigint", "node": "bigint", "size": "bigint", "fp": "bigint"}
    hashed = docs.select(id_col, _text_hash(text_col).alias("th"), text_col)
    return scan(hashed, [id_col, "th", text_col], start, {**out, "bands": "array<bigint>"})


def _fingerprint_buckets(marked: DataFrame, spark: SparkSession, radius: int) -> DataFrame:
    """(bucket, node) of equal and of near fingerprints."""
    have = settle(marked.where("size > 0").select("fp", "node").distinct(), spark, "prints")
    prints = settle(have.groupBy("fp").count(), spark, "prints")
    nodes = prints.select("fp")
    pairs = simhash.near_pairs(nodes, spark, radius, simhash.segments_for(nodes.count(), radius))
    ends = pairs.select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("fp"))
    own = prints.where("count > 1").select(F.xxhash64("fp").alias("bucket"), "fp")
    return ends.unionByName(own).join(have, "fp").select("bucket", "node")


def _buckets(marked: DataFrame, spark: SparkSession, radius: int) -> DataFrame:
    """(bucket, node, size, weight) of the buckets that hold two sets or more.

    A set's weight is the number of others it meets, over all its buckets.
    """
    sets = marked.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    banded = sets.select(F.explode("bands").alias("bucket"), "node")
    rows = settle(banded.unionByName(_fingerprint_buckets(marked, spark, radius)).distinct(), spark, "buckets")
    shared = rows.groupBy("bucket").count().where("count > 1")
    met = settle(rows.join(shared, "bucket"), spark, "buckets")
    weights = met.groupBy("node").agg((F.sum("count") - F.count("*")).alias("weight"))
    sizes = marked.groupBy("node").agg(F.first("size").alias("size"))
    return settle(met.drop("count").join(weights.join(sizes, "node"), "node").select("bucket", "node", "size", "weight"), spark, "buckets")


def _sets(docs: DataFrame, marked: DataFrame, nodes: DataFrame, width: int, text_col: str) -> DataFrame:
    """(node, shingles) of the given nodes, each read from one of its texts."""
    chosen = marked.groupBy("node").agg(F.min("th").alias("th")).join(nodes, "node", "left_semi").select("th")
    # Copies of one text are dealt over several tasks, each of which hands on one.
    every = chosen.select("th", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.floor(F.rand(simhash.SEED) * SALTS).cast("int")
    texts = docs.select(_text_hash(text_col).alias("th"), F.coalesce(text_col, F.lit("")).alias("words"), salt.alias("salt"))
    once = texts.join(every, ["th", "salt"], "left_semi").dropDuplicates(["th", "salt"]).groupBy("th").agg(F.min("words").alias("words"))

    def start():
        def work(words):
            sets = [shingle_set(t, width) for t in texts_of(words)]
            return {
                "node": ([name_of(s) for s in sets], pa.int64()),
                "shingles": ([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            }

        return work

    return scan(once, ["words"], start, {"node": "bigint", "shingles": "array<bigint>"})


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both / (F.size("x") + F.size("y") - both) >= least
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def alike_in_parts(nodes, roots, parts, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """The alike pairs (a, b), a < b, of sets of different roots; of two parts, only pairs across them."""
    nodes, roots, parts = (np.asarray(v) for v in (nodes, roots, parts))
    sizes = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    wanted = np.triu(roots[:, None] != roots[None, :], 1)
    if len(np.unique(parts)) > 1:
        wanted &= parts[:, None] != parts[None, :]
    need = least / (1 + least) * (sizes[:, None] + sizes[None, :]) - 1e-6
    while True:  # a shingle that one set alone has is no part of any overlap
        _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.bincount(owner[counts[column] > 1], minlength=len(sets))
        wanted &= np.minimum(common[:, None], common[None, :]) >= need
        live = wanted.any(axis=0) | wanted.any(axis=1)
        stay = live[owner] & (counts[column] > 1)
        if stay.all():
            break
        owner, flat = owner[stay], flat[stay]
    rows = np.flatnonzero(live)
    if not len(rows):
        return []
    place = np.zeros(len(sets), np.int64)
    place[rows] = np.arange(len(rows))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], place[owner[order]]
    overlap = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        has = np.zeros((len(rows), min(4096, int(column[-1]) + 1 - low)), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        overlap += has @ has.T
    i, j = np.nonzero(wanted[np.ix_(rows, rows)])
    both, total = overlap[i, j].astype(np.float64), sizes[rows[i]] + sizes[rows[j]]
    enough = both / (total - both) >= least
    a, b = nodes[rows[i[enough]]], nodes[rows[j[enough]]]
    return list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))


def _alike_in_buckets(rest: DataFrame, sets: DataFrame, spark: SparkSession, least: float) -> DataFrame:
    """Links (a, b) of all sets of a bucket with all, compared part by part inside tasks."""
    wide = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int")
    dealt = rest.join(wide.select("bucket", parts.alias("parts")), "bucket")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "root"
    )

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if rows.num_rows < 2:
            found = []
        else:
            lists = rows["shingles"].combine_chunks() if isinstance(rows["shingles"], pa.ChunkedArray) else rows["shingles"]
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            made = np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])
            found = alike_in_parts(rows["node"].to_numpy(), rows["root"].to_numpy(), rows["part"].to_numpy(), made, least)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = settle(placed, spark, "parts").join(sets, "node")
    return met.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def links(
    docs: DataFrame, marked: DataFrame, spark: SparkSession, least: float, width: int, radius: int, text_col: str
) -> DataFrame:
    """(node, root) of every node that is linked to another."""
    rest = _buckets(marked, spark, radius).withColumn("root", F.col("node"))
    sets = settle(_sets(docs, marked, rest.select("node").distinct(), width, text_col), spark, "shingles")
    found = roots = None
    before, first_round = rest.count(), True

    def apart(rows: DataFrame) -> DataFrame:
        """The rows with their new roots, of buckets that still hold several groups."""
        rows = rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = settle(rows.select("bucket", "node", "size", "weight", "root"), spark, "apart")
        mixed = rows.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s")
        return settle(rows.join(mixed.select("bucket"), "bucket"), spark, "apart")

    while True:
        leader = F.max(F.struct("weight", (-F.col("node")).alias("by"), "node", "size", "root")).alias("f")
        leaders = rest.groupBy("bucket").agg(leader)
        leaders = settle(leaders.select("bucket", *(F.col(f"f.{c}").alias(f"{c}_b") for c in ("node", "size", "root"))), spark, "leaders")
        met = rest.join(leaders.withColumnRenamed("node_b", "b"), "bucket").where("node != b")
        fit = F.least("size", "size_b") >= least * F.greatest("size", "size_b") - 1e-6
        pairs = met.where((F.col("root") != F.col("root_b")) & fit).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        made = settle(_alike(settle(pairs.distinct(), spark, "pairs"), sets, least), spark, "links")
        found = made if found is None else found.unionByName(made)
        roots = simhash.components(found, spark)
        rest = apart(met.select("bucket", "node", "size", "weight", "root"))
        now = rest.count()
        if not now:
            return roots
        if now > SHRINK * before and not first_round:
            break
        before, first_round = now, False
    made = settle(_alike_in_buckets(rest, sets, spark, least), spark, "links")
    return simhash.components(found.unionByName(made), spark)


def keep_one(
    docs: DataFrame,
    spark: SparkSession,
    keep: tuple[str, ...],
    least: float = 0.8,
    width: int = 5,
    radius: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``keep`` columns of one document of each group: the one of the smallest id.

    Of texts that share this id the one of the smallest hash stays; rows that repeat both stay once.
    """
    docs = pick(docs, *dict.fromkeys((id_col, text_col, *keep)))
    marked = settle(_marked(docs, width, id_col, text_col), spark, "marked")
    roots = links(docs, marked, spark, least, width, radius, text_col)
    lowest = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "th")
    named = settle(marked.groupBy("node").agg(F.min(lowest).alias("least")), spark, "named")
    rooted = named.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    chosen = rooted.groupBy("root").agg(F.min("least").alias("c")).select(F.col("c.id").alias("chosen"), F.col("c.th").alias("by"))
    chosen = settle(chosen, spark, "chosen")
    rows = docs.withColumn("text hash", _text_hash(text_col))
    same = F.col(id_col).eqNullSafe(F.col("chosen")) & (F.col("text hash") == F.col("by"))
    return rows.join(chosen, same, "left_semi").dropDuplicates([id_col, "text hash"]).select(*keep)
