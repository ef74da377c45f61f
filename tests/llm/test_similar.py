"""Near-dedup by exact similarity: every link of a brute force over all pairs, and no other."""

import random

import numpy as np
import pytest
from test_pipeline import jaccard
from test_simhash import roots

import corpus_pipeline
from visitgrain.llm import similar, simhash
from visitgrain.llm.common import read_table

COLUMNS = ("doc_id", "text")


def words_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, words, share, block):
    """The words with a share of them replaced: in one block, or scattered."""
    out, n = list(words), max(1, round(share * len(words)))
    at = rng.randrange(len(words) - n)
    for i in range(at, at + n) if block else rng.sample(range(len(words)), n):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def kept(docs, spark):
    return sorted(r.doc_id for r in similar.keep_one(docs, spark, COLUMNS).collect())


def test_every_similar_pair_is_found(spark, documents):
    rng, texts, pairs = random.Random(8), [], []
    while len(pairs) < 60:
        words = words_of(rng, rng.randrange(100, 300))
        block = len(pairs) % 2 == 0
        a, b = " ".join(words), " ".join(changed(rng, words, rng.uniform(0.05, 0.12) if block else rng.uniform(0.01, 0.03), block))
        if 0.8 <= jaccard(a, b) < 0.85:
            pairs.append((len(texts), len(texts) + 1))
            texts += [a, b]
    far = [(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 5 for a, b in pairs]
    assert sum(far) > 20
    assert kept(documents(texts), spark) == [a for a, _ in pairs]


def test_groups_equal_all_comparisons(spark, documents):
    rng, texts = random.Random(9), []
    for _ in range(6):
        base = words_of(rng, 120)
        texts += [" ".join(changed(rng, base, rng.choice([0.005, 0.02, 0.04]), rng.random() < 0.5)) for _ in range(25)]
    links = roots((a, b) for a in range(len(texts)) for b in range(a, len(texts)) if jaccard(texts[a], texts[b]) >= 0.8)
    assert kept(documents(texts), spark) == sorted(set(links.values()))


def test_equal_fingerprints_of_unlike_texts_stay(spark, documents):
    rng = random.Random(10)
    texts = ["all rights reserved by us " * 40 + " ".join(words_of(rng, 60)) for _ in range(40)]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    assert kept(documents(texts), spark) == list(range(40))


def test_texts_without_ids_are_compared(spark, documents):
    rng = random.Random(11)
    one = "all rights reserved by us " * 40
    texts = [one + " ".join(words_of(rng, 60)) for _ in range(3)]
    docs = documents([(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (4, texts[2]), (None, texts[2])])
    out = sorted(((r.doc_id or 0, r.text) for r in similar.keep_one(docs, spark, COLUMNS).collect()))
    assert out == sorted([(0, texts[0]), (0, texts[1]), (4, texts[2])])
    assert kept(documents([]), spark) == []


def brute(texts, least=0.8):
    links = roots((a, b) for a in range(len(texts)) for b in range(a, len(texts)) if jaccard(texts[a], texts[b]) >= least)
    return sorted(set(links.values()))


@pytest.mark.parametrize("origin", [True, False])
def test_copies_unlike_each_other(spark, documents, monkeypatch, origin):
    """Two of 100 words edited: alike to their origin, about 0.66 to each other."""
    rng = random.Random(13)
    base = words_of(rng, 100)
    texts = [" ".join(base)] * origin + [" ".join(changed(rng, base, 0.02, False)) for _ in range(120)]
    monkeypatch.setattr(similar, "PART", 40)
    compared, alike = [], similar._alike
    monkeypatch.setattr(similar, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or alike(pairs, *rest))
    in_parts, whole = [], similar._alike_in_buckets
    monkeypatch.setattr(similar, "_alike_in_buckets", lambda rest, *more: in_parts.append(rest.count()) or whole(rest, *more))
    assert kept(documents(texts), spark) == brute(texts)
    assert max(compared) < 10 * len(texts)  # rows of joins grow with the texts, not with their pairs
    assert bool(in_parts) != origin


def test_texts_with_one_common_line(spark, documents, monkeypatch):
    rng = random.Random(14)
    line = " ".join(words_of(rng, 40))
    texts = [f"{line} {' '.join(words_of(rng, 30))}" for _ in range(120)]
    compared, alike = [], similar._alike
    monkeypatch.setattr(similar, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or alike(pairs, *rest))
    assert kept(documents(texts), spark) == list(range(120)) == brute(texts)
    assert sum(compared) < 10 * len(texts)


def test_parts_equal_all_comparisons():
    rng = random.Random(15)
    for _ in range(30):
        base = rng.sample(range(10**6), 40)
        sets = [np.array(sorted({*rng.sample(base, rng.randrange(1, 41)), *rng.sample(range(10**6), rng.randrange(6))})) for _ in range(30)]
        names, groups = rng.sample(range(-500, 500), 30), [rng.randrange(8) for _ in range(30)]
        for parts in ([0] * 30, [rng.randrange(2) for _ in range(30)]):
            want = {tuple(sorted((names[i], names[j]))) for i in range(30) for j in range(i) if groups[i] != groups[j]
                    and (len(set(parts)) == 1 or parts[i] != parts[j])
                    and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.6}
            assert set(similar.alike_in_parts(names, groups, parts, sets, 0.6)) == want


def test_one_of_each_group_stays(spark, documents):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    near = base[0].replace(base[0].split()[150], "changed", 1)
    rows = [(5, base[0]), (4, near), (9, base[0]), (1, base[1]), (1, base[1]), (2, base[2]), (None, base[3]), (None, base[3]), (7, None), (8, "")]
    out = similar.keep_one(documents(rows), spark, COLUMNS).collect()
    assert sorted((r.doc_id or -1 for r in out)) == [-1, 1, 2, 4, 7]


@pytest.mark.parametrize("low,least", [(0.8, 0.05), (0.85, 0.15), (0.9, 0.5), (0.95, 0.75)])
def test_recall_of_simhash(low, least):
    """Without the bands: a fingerprint of a set within five bits. The bands find the rest."""
    rng, met, all_ = random.Random(12), 0, 0
    while all_ < 150:
        words = words_of(rng, rng.randrange(100, 300))
        block = rng.random() < 0.5
        other = changed(rng, words, (1 - low) * (rng.uniform(0.1, 0.8) if block else rng.uniform(0.02, 0.2)), block)
        x, y = (similar.shingle_set(" ".join(w)) for w in (words, other))
        if low <= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < low + 0.05:
            all_ += 1
            met += (simhash.fingerprint_of(x) ^ simhash.fingerprint_of(y)).bit_count() <= 5
    assert met >= least * all_


@pytest.mark.parametrize("low", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_the_bands(low):
    """Without SimHash, in each range of similarity."""
    rng, met, all_ = random.Random(12), 0, 0
    while all_ < 150:
        words = words_of(rng, rng.randrange(100, 300))
        block = rng.random() < 0.5
        other = changed(rng, words, (1 - low) * (rng.uniform(0.1, 0.8) if block else rng.uniform(0.02, 0.2)), block)
        if low <= jaccard(" ".join(words), " ".join(other)) < low + 0.05:
            all_ += 1
            a, b = (similar.bands_of(similar.shingle_set(" ".join(w))) for w in (words, other))
            met += bool(np.intersect1d(a, b).size)
    assert met == all_


def test_stage_equals_all_comparisons_of_the_data(spark, sf_dir):
    """Brute force over the documents' sets, without any cut of fingerprints."""
    docs = read_table(spark, sf_dir, "documents")
    sets = {r.doc_id: set(similar.shingle_set(r.text or "").tolist()) for r in docs.collect()}

    def alike(x, y):
        return len(x & y) / len(x | y) >= 0.8 if x | y else True

    links = roots((a, b) for a in sets for b in sets if a <= b and alike(sets[a], sets[b]))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect())
    assert got == sorted(set(links.values()))
