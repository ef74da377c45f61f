import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from visitgrain.llm import token_counts as C

VERSIONS = {v: public_tokenizers.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}


@pytest.fixture
def ledger(spark, folder):
    return C.Ledger(spark, folder("ledger"))


@pytest.fixture
def deltas(spark):
    return lambda rows: spark.createDataFrame(rows, C._BATCH)


def totals(ledger):
    return sorted(map(tuple, ledger.totals().collect()), key=str)


def test_batches_add_up_once_in_any_order(spark, ledger, deltas, folder):
    batches = {
        "in": [("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 7), (None, None, "v1", 1, 3)],
        "out": [("a", "en", "v1", -1, -7), (None, None, "v1", -1, -3)],
        "new": [("a", "en", "v1", -1, -10), ("a", "en", "v2", 1, 12)],
    }
    other = C.Ledger(spark, folder("other"))
    for name in batches:
        assert ledger.commit(name, deltas(batches[name]))
        assert not ledger.commit(name, deltas(batches[name]))
    for name in reversed(batches):
        other.commit(name, deltas(batches[name]))
    assert totals(ledger) == totals(other) == [("a", "en", "v2", 1, 12)]


def test_compaction_keeps_totals_and_names(ledger, deltas):
    assert totals(ledger) == [] and ledger.batches() == []
    ledger.commit("one", deltas([("a", "en", "v", 2, 20)]))
    ledger.commit("two", deltas([("b", None, "v", 1, 5)]))
    before = totals(ledger)
    ledger.compact()
    assert totals(ledger) == before and ledger.batches() == ["one", "two"]
    assert not ledger.commit("one", deltas([("a", "en", "v", 2, 20)]))
    ledger.commit("three", deltas([("a", "en", "v", -2, -20)]))
    assert totals(ledger) == [("b", None, "v", 1, 5)]
    ledger.compact()
    assert totals(ledger) == [("b", None, "v", 1, 5)] and ledger.batches() == ["one", "three", "two"]


def test_broken_attempt_is_written_anew(spark, ledger, deltas, folder):
    import os

    ledger.commit("one", deltas([("a", "en", "v", 1, 9)]))
    os.remove(f"{ledger.folder}/batches/one/_SUCCESS")  # as if the job had ended half way
    assert ledger.batches() == []
    assert ledger.commit("one", deltas([("a", "en", "v", 1, 9)])) and totals(ledger) == [("a", "en", "v", 1, 9)]
    with pytest.raises(ValueError):
        ledger.commit("../x", deltas([]))


def test_counts_equal_the_library(documents, odd_texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for t in odd_texts if len(t or "") < 40_000]
    counted = C.count_tokens(documents(texts), VERSIONS, public_tokenizers.PATTERN, ("doc_id",)).collect()
    for r in counted:
        want = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert r.counts["byte_bpe_50k"] == want and set(r.counts) == set(VERSIONS)
    assert C.count_tokens(documents([]), VERSIONS, public_tokenizers.PATTERN, ("doc_id",)).collect() == []


def test_a_name_is_not_given_to_other_totals(ledger, deltas):
    ledger.commit("one", deltas([("a", None, "v", 2, 20)]))
    assert not ledger.commit("one", deltas([("a", None, "v", 1, 15), ("a", None, "v", 1, 5)]))
    with pytest.raises(ValueError):
        ledger.commit("one", deltas([("a", None, "v", 2, 21)]))
    ledger.compact()
    with pytest.raises(ValueError):
        ledger.commit("one", deltas([]))
    assert totals(ledger) == [("a", None, "v", 2, 20)]


def test_whole_query_over_odd_rows(spark, folder):
    from visitgrain.llm.queries import op10_token_counts

    one, many = (C._encoding(path, public_tokenizers.PATTERN) for path in VERSIONS.values())
    rows = [
        (None, "no id here", "en", "b"), (None, "no id here", "de", "a"), (3, "zwei Worte", "de", "a"), (3, "zwei Worte", "de", "a"),
        (2, "zwei Worte", None, None), (5, None, "en", "a"), (6, "", "fr", "a"), (7, "alone", "en", None), (None, "alone", "fr", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    first = {}
    for i, t, lang, source in rows:
        key = (i is None, i or 0, source is not None, source or "", lang or "")
        first[t or ""] = min(first.get(t or "", (key, lang, source)), (key, lang, source), key=lambda x: x[0])
    want = {}
    for text, (_, lang, source) in first.items():
        name, lib = ("byte_bpe_50k", one) if lang == "en" else ("byte_bpe_multi_50k", many)
        got = want.setdefault((source, lang, name), [0, 0])
        got[0] += 1
        got[1] += len(lib.encode_ordinary(text))
    for k, (made, expected) in enumerate(((rows, want), ([], {}))):
        place = folder(f"docs{k}")
        spark.createDataFrame(made, schema).withColumn("counts", F.lit("clash")).write.parquet(f"{place}/documents.parquet")
        out = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in op10_token_counts(spark, place).collect()}
        assert out == expected
