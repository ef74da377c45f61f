import random

import numpy as np
import pytest
import xxhash

from visitgrain.llm import simhash


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.fixture(scope="module")
def prints():
    rng = random.Random(5)
    found = {0, (1 << 64) - 1}
    for centre in [rng.getrandbits(64) for _ in range(20)] + [0]:
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    found |= {rng.getrandbits(3) << 40 | 12345 | rng.getrandbits(4) << 60 for _ in range(50)}
    return sorted(found)


@pytest.mark.parametrize("radius,segments,crowd", [(2, 2, None), (2, 2, 4), (2, 3, 3), (5, 3, None), (0, 1, None)])
def test_pairs_equal_all_comparisons(spark, prints, radius, segments, crowd):
    nodes = spark.createDataFrame([(signed(v),) for v in prints], "fp long")
    a = np.array(prints, np.uint64)
    close = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    want = sorted({tuple(sorted((signed(prints[i]), signed(prints[j])))) for i, j in zip(*np.nonzero(close)) if i < j})
    got = sorted((r.a, r.b) for r in simhash.near_pairs(nodes, spark, radius, segments, crowd).collect())
    assert got == want


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    pairs += [tuple(rng.sample(range(300, 360), 2)) for _ in range(45)]
    df = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in pairs], "a long, b long")
    assert {r.node: r.root for r in simhash.components(df, spark).collect()} == roots(pairs)


def test_fingerprints(odd_texts):
    for text in odd_texts + ["one two", "One TWO three", "one two three four"]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)
    assert simhash.fingerprint("") == 0


def test_groups_of_odd_rows(spark, documents, odd_texts):
    rows = [(10 + i, t) for i, t in enumerate(odd_texts)] + [(3, "same text here"), (None, "same text here"), (3, "same text here")]
    rows += [(None, "no id at all")]
    out = simhash.near_duplicates(documents(rows), spark, radius=2, segments=2).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    links = roots((a, b) for _, a in prints for _, b in prints if a <= b and (a ^ b).bit_count() <= 2)
    want = []
    for i, p in prints:
        ids = [j for j, q in prints if links[q] == links[p] and j is not None]
        want.append((i, signed(p), min(ids, default=None)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(documents([]), spark).collect() == []

