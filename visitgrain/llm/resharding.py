"""Resharding by minimum-cost flow: fewest bytes moved from old shard sizes to new capacities.

1. Old shards are cut into blocks by a hash of the id and the text's checksum; one aggregate gives
   each block's rows and bytes. Blocks are the unit of transfer; there are ``blocks`` of them in each
   old shard, however large or hot it is. Where rows that repeat both the id and the text make a block
   of more than ``HOT`` of a new shard, the rows are first written with a random salt, which then
   counts for the hash, so that no group of equal rows is indivisible.
2. A flow network over shards (never over rows): an old shard supplies its bytes, a new shard takes
   its capacity, a byte that stays costs nothing and a byte that moves costs one, or what ``cost``
   says. Successive shortest paths give the flow of least cost.
3. Each flow becomes a set of blocks whose sizes add up to it as nearly as whole blocks allow.
4. Only shards that gain or lose a block are written anew; the others keep their files.

The law kept is ``bytes``: sizes of new shards follow the capacities to within a block.

Defined results: a null text has no bytes; a row's size is its bytes plus one; null and
repeated ids are dealt by their texts, and equal rows by the salt; a null old shard counts as shard 0; an empty
table gives empty shards; other columns of the input are carried along by ``rewrite`` and ignored
elsewhere.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from visitgrain.llm.common import pick, settle

LAW = "bytes"
#: Share of a new shard from which a block of several rows is split by a salt.
HOT = 0.01
SALT = "deal salt"


def row_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text plus one."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1


def text_crc(text_col: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def least_cost_flow(
    supply: Sequence[int], capacity: Sequence[int], cost: Callable[[int, int], int] | None = None
) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one: all supply is sent, at the least total cost.

    Successive shortest paths with potentials over the two-sided graph of shards; ``capacity`` must
    hold the supply.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities can't hold the bytes")
    cost = cost or (lambda i, j: int(i != j))
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    price = [0] * (n + m)  # potentials of old shards, then of new ones
    while any(left):
        far = [float("inf")] * (n + m)
        by: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            if u < n:
                steps = ((n + j, cost(u, j)) for j in range(m))
            else:
                steps = ((i, -cost(i, u - n)) for i in range(n) if flow[i, u - n] > 0)
            for v, c in steps:
                reached = d + c + price[u] - price[v]
                if reached < far[v]:
                    far[v], by[v] = reached, u
                    heapq.heappush(heap, (reached, v))
        ends = [(far[n + j] + price[n + j], j) for j in range(m) if room[j] and far[n + j] < float("inf")]
        _, j = min(ends)
        price = [p + (d if d < float("inf") else 0) for p, d in zip(price, far)]
        way, u = [], n + j
        while by[u] is not None:
            way.append((by[u], u))
            u = by[u]
        sent = min([left[u], room[j], *(flow[v, w - n] for w, v in way if w >= n)])
        for a, b in way:
            if a < n:
                flow[a, b - n] += sent
            else:
                flow[b, a - n] -= sent
        left[u] -= sent
        room[j] -= sent
    return {pair: f for pair, f in flow.items() if f}


@dataclass(frozen=True)
class Plan:
    """``home``: new shard of each block; ``first``: rows before a block in its new shard; ``largest``:
    bytes of the largest block of several rows."""

    home: dict[tuple[int, int], int]
    first: dict[tuple[int, int], int]
    flow: dict[tuple[int, int], int]
    moved: int
    affected: frozenset[int]
    largest: int
    total: int


def plan_blocks(
    sizes: dict[tuple[int, int], tuple[int, int]], capacity: Sequence[int], cost: Callable[[int, int], int] | None = None
) -> Plan:
    """Choose a new shard for every (old shard, block), given its (rows, bytes)."""
    old = max((s for s, _ in sizes), default=-1) + 1
    supply = [0] * old
    for (s, _), (_, b) in sizes.items():
        supply[s] += b
    flow = least_cost_flow(supply, capacity, cost)
    home: dict[tuple[int, int], int] = {}
    for s in range(old):
        own = sorted(((sizes[k][1], k) for k in sizes if k[0] == s), reverse=True)
        stays = flow.get((s, s), 0)
        # What leaves, largest flow last to take up what whole blocks can't match.
        wanted = {j: f for (i, j), f in flow.items() if i == s and j != s}
        if not stays and wanted:
            rest = max(wanted, key=lambda j: (wanted[j], -j))
            del wanted[rest]
        else:
            rest = s
        for size, key in own:  # largest blocks first, into the largest need they fit
            fit = [j for j in wanted if wanted[j] >= size]
            if fit:
                j = max(fit, key=lambda j: (wanted[j], -j))
                home[key] = j
                wanted[j] -= size
        for size, key in reversed(own):  # then the smallest blocks, where that comes nearer
            need = max(wanted, key=lambda j: (wanted[j], -j), default=None)
            if key not in home and need is not None and 2 * wanted[need] > size:
                home[key] = need
                wanted[need] -= size
        for _, key in own:
            home.setdefault(key, rest)
    first, filled = {}, defaultdict(int)
    for key in sorted(sizes):
        first[key] = filled[home[key]]
        filled[home[key]] += sizes[key][0]
    moved = {k: j for k, j in home.items() if j != k[0]}
    return Plan(
        home,
        first,
        flow,
        sum(sizes[k][1] for k in moved),
        frozenset(j for k, to in moved.items() for j in (k[0], to)),
        max((b for r, b in sizes.values() if r > 1), default=0),
        sum(supply),
    )


def reshard(
    docs: DataFrame,
    spark: SparkSession,
    old_shard: Column,
    shards: int = 8,
    blocks: int = 1024,
    shares: Sequence[int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, Plan, Column, Column]:
    """The blocks' table (old, block, shard, first), the plan, and the columns old and block.

    ``shares`` weighs the new capacities; equal without it. The table has one row per block that
    holds rows: at most ``blocks`` for each old shard. A column ``SALT`` of the rows counts for the block.
    """
    old = F.coalesce(old_shard, F.lit(0)).cast("int")
    salt = [SALT] if SALT in docs.columns else []
    block = F.pmod(F.xxhash64(id_col, text_crc(text_col), *salt), F.lit(blocks)).cast("int")
    counted = docs.groupBy(old.alias("old"), block.alias("block")).agg(
        F.count("*").alias("rows"), F.sum(row_size(text_col)).alias("bytes")
    )
    sizes = {(r.old, r.block): (r.rows, r.bytes) for r in counted.collect()}
    total, shares = sum(b for _, b in sizes.values()), list(shares or [1] * shards)
    edges = [total * sum(shares[:j]) // sum(shares) for j in range(len(shares) + 1)]
    plan = plan_blocks(sizes, [b - a for a, b in zip(edges, edges[1:])])
    rows = [(*k, plan.home[k], plan.first[k]) for k in sorted(sizes)]
    return spark.createDataFrame(rows, "old int, block int, shard int, first bigint"), plan, old, block


def rewrite(
    docs: DataFrame,
    spark: SparkSession,
    table: DataFrame,
    plan: Plan,
    old: Column,
    block: Column,
    folder: str,
    columns: Sequence[str],
) -> DataFrame:
    """Write the affected shards under ``folder`` and return all rows with ``old``, ``block``, ``shard``.

    Rows go from where they lie straight into their shard's folder: texts are not shuffled. Rows of
    shards that nothing enters or leaves are read from where they are.
    """
    placed = (
        docs.select(*columns, old.alias("old"), block.alias("block"))
        .join(F.broadcast(table.select("old", "block", "shard")), ["old", "block"])
        .select(*columns, "old", "block", "shard")
    )
    affected = F.col("shard").isin(*plan.affected) if plan.affected else F.lit(False)
    if not plan.affected:
        return placed
    placed.where(affected).write.partitionBy("shard").parquet(folder)
    written = spark.read.schema(placed.schema).parquet(folder).select(*placed.columns)
    return written.unionByName(placed.where(~affected))


def assignments(
    docs: DataFrame,
    spark: SparkSession,
    old_shard: Column,
    folder: str,
    shards: int = 8,
    blocks: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_columns: Sequence[str] = (),
) -> DataFrame:
    """One row per document, from the shards' files: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    ``shard_columns`` are those that ``old_shard`` is made of. Slots count from 0 in each shard,
    block by block; within a block by id. The window is over blocks, so its groups stay small in a
    hot shard too.
    """
    names = list(dict.fromkeys((id_col, text_col, *shard_columns)))
    docs = pick(docs, *names)
    how = (spark, old_shard, shards, blocks, None, id_col, text_col)
    table, plan, old, block = reshard(docs, *how)
    if plan.largest * shards > HOT * plan.total:
        docs = settle(docs.withColumn(SALT, F.floor(F.rand() * (1 << 30)).cast("int")), spark, "salted")
        table, plan, old, block = reshard(docs, *how)
    rows = rewrite(docs, spark, table, plan, old, block, folder, names).select(
        id_col,
        row_size(text_col).alias("size"),
        text_crc(text_col).alias("text_crc32"),
        "old",
        "block",
        "shard",
    )
    within = Window.partitionBy("old", "block").orderBy(id_col, "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(table.select("old", "block", "first")), ["old", "block"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("bigint").alias("slot"))
    )
