import random

import pytest

from visitgrain.llm import decontaminate as D


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, items string")


def brute(docs, items, least=0.8, width=5):
    out = []
    for d, text in docs:
        words = D.words_of(text or "")
        for i, item in dict.fromkeys(items):
            own = D.words_of(item or "")
            n = min(width, len(own))
            want = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if want and len(want & have) >= least * len(want) - 1e-9:
                out.append((d, i, len(want & have), len(want)))
    return sorted(out)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 17, 40, 64, 65])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (3, items[3][1]), (200, "ça va Œuvre ½ x1 élan")]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rng.randint(0, 300))]
        if d % 2:
            part = items[rng.randrange(40)][1].split()
            for _ in range(rng.randrange(3)):  # some words changed
                part[rng.randrange(len(part))] = "changed"
            cut = rng.randrange(len(part) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[:cut] + (["between"] if d % 4 == 1 else []) + part[cut:]
        docs.append((d, " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", ",", ".\n"]) for w in words)))
    return docs + [(500, None), (501, ""), (502, "ÇA VA: œuvre ½, x1 élan!"), (0, docs[1][1])], items


def found(docs, benchmark, spark, **how):
    return sorted((r.doc_id, r.item_id, r.shared, r.size) for r in D.find_items(docs, benchmark, spark, **how).collect())


def test_equals_exact_containment(spark, documents, items, case):
    want = brute(*case)
    assert len({d for d, *_ in want}) > 30
    assert found(documents(case[0]), items(case[1]), spark) == want


def test_blocks_change_no_result(spark, documents, items, case):
    assert found(documents(case[0]), items(case[1]), spark, block=300) == brute(*case)


def test_contaminated_documents_go(spark, documents, items, case):
    bad = {d for d, *_ in brute(*case)}
    for block in (D.BLOCK, 400):
        out = D.drop_contaminated(documents(case[0]), items(case[1]), spark, ("doc_id", "text"), block=block)
        kept = sorted(r.doc_id for r in out.collect())
        assert kept == sorted(d for d, t in case[0] if not any(d == b for b in bad if (d, t) in case[0] and brute([(d, t)], case[1])))


def test_long_document_and_empty_tables(spark, documents, items):
    rng = random.Random(12)
    long_text = " ".join(str(rng.randrange(10**6)) for _ in range(40_000))
    item = " ".join(long_text.split()[30_000:30_020])
    assert found(documents([long_text]), items([(1, item), (2, "not in there at all my friend")]), spark) == [(0, 1, 16, 16)]
    assert found(documents([]), items([(1, item)]), spark) == [] and found(documents(["a"]), items([]), spark) == []
