import os
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from visitgrain.llm import resharding as R


def least_by_trial(supply, capacity, cost):
    """Least cost over all ways to send whole units."""
    best = None
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    for to in product(range(len(capacity)), repeat=len(units)):
        if all(n <= capacity[j] for j, n in Counter(to).items()):
            total = sum(cost[i][j] for i, j in zip(units, to))
            best = total if best is None else min(best, total)
    return best


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(n)]
        capacity = [rng.randint(0, 4) for _ in range(m)]
        if sum(capacity) < sum(supply):
            continue
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = R.least_cost_flow(supply, capacity, lambda i, j: cost[i][j])
        assert all(sum(f for (i, _), f in flow.items() if i == k) == supply[k] for k in range(n))
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= capacity[k] for k in range(m))
        assert sum(f * cost[i][j] for (i, j), f in flow.items()) == least_by_trial(supply, capacity, cost)


def test_fewest_bytes_move():
    supply, capacity = [1000, 10, 300, 0, 77], [200, 400, 300, 487, 0, 0]
    flow = R.least_cost_flow(supply, capacity)
    stays = sum(min(s, c) for s, c in zip(supply, capacity))
    assert sum(f for (i, j), f in flow.items() if i != j) == sum(supply) - stays
    with pytest.raises(ValueError):
        R.least_cost_flow([5], [4])


def test_blocks_follow_the_flow():
    rng = random.Random(2)
    sizes = {(s, b): (rng.randint(1, 5), rng.randint(1, 900)) for s in range(3) for b in range(200)}
    total = sum(b for _, b in sizes.values())
    plan = R.plan_blocks(sizes, [total // 8] * 7 + [total - total // 8 * 7])
    filled = Counter()
    for key, j in plan.home.items():
        filled[j] += sizes[key][1]
    assert max(filled.values()) - min(filled.values()) < 900
    least = sum(f for (i, j), f in plan.flow.items() if i != j)
    assert plan.moved <= least + 900 * len(plan.flow)


def assigned(docs, spark, folder, **how):
    old = (F.crc32(F.col("source").cast("binary")) % 3).cast("int")
    return R.assignments(docs, spark, old, folder, shard_columns=("source",), **how).collect()


def test_every_row_once_and_gapless(spark, documents, folder, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "x"), (None, None), (2, "again"), (2, "again")]
    rows += [(100 + i, "w" * (i % 97)) for i in range(600)]
    out = assigned(documents(rows), spark, folder("a"), blocks=64)
    import zlib

    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_sizes_near_equal(spark, documents, folder):
    rng = random.Random(3)
    docs = documents([(i, "w" * rng.randint(0, 500)) for i in range(3000)])
    sizes = Counter()
    for r in assigned(docs, spark, folder("b")):
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2500


@pytest.mark.parametrize("hot", [lambda i: (None, f"text {i}"), lambda i: (7, f"text {i}"), lambda i: (None, "same"), lambda i: (7, "same")])
def test_sizes_near_equal_with_a_third_of_one_id(spark, documents, folder, hot):
    """Null or one id, with texts of their own or one text."""
    rows = [hot(i) if i % 3 == 0 else (10 + i, f"text {i}") for i in range(24000)]
    sizes, slots = Counter(), defaultdict(list)
    for r in assigned(documents(rows, extra=False), spark, folder("h")):
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)


def test_only_affected_shards_are_written(spark, documents, folder):
    """Shards 0 and 1 hold their capacity; 2 is full and 3 is empty."""
    docs = documents([(i, "w" * 9) for i in range(400)], extra=False).withColumn(
        "at", F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 200, 1).otherwise(2)
    )
    table, plan, old, block = R.reshard(docs, spark, F.col("at"), shards=4, blocks=400)
    assert plan.affected == {2, 3} and plan.moved <= 1010
    where = folder("c")
    rows = R.rewrite(docs, spark, table, plan, old, block, where, ("doc_id", "text"))
    assert rows.count() == 400
    assert sorted(d for d in os.listdir(where) if d.startswith("shard=")) == ["shard=2", "shard=3"]


def test_empty_table(spark, documents, folder):
    assert assigned(documents([]), spark, folder("d")) == []
