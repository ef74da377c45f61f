"""The registered queries over a whole data folder, beside SQL or brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import connect, differences
from test_pii import brute as pii_brute
from test_secrets import brute as secrets_brute
from test_simhash import plain_fingerprint, roots
from tokenizers import Tokenizer

from visitgrain.llm import queries as Q
from visitgrain.llm.common import read_table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in read_table(spark, sf_dir, "documents").collect()}


def run(spark, sf_dir, name):
    return Q.QUERIES[name](spark, sf_dir).collect()


def test_all_are_registered(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in Q.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), sf_dir, name, Q.QUERIES[name], Q.ORACLES[name]) is None


@pytest.mark.parametrize(
    "name,brute,kinds",
    [
        ("op1_secret_scan", secrets_brute, ("assign", "access", "hex")),
        ("op9_pii", pii_brute, ("email", "ip", "card", "phone")),
    ],
)
def test_spans(spark, sf_dir, texts, name, brute, kinds):
    out = run(spark, sf_dir, name)
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        spans = brute(texts[r.doc_id])
        line = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in spans) for i in range(len(kinds))]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_quality(spark, sf_dir, texts):
    out = run(spark, sf_dir, "op2_quality_classifier")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_resharding(spark, sf_dir, texts):
    out = run(spark, sf_dir, "op3_resharding")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8


def test_near_duplicates(spark, sf_dir, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    links = roots((i, j) for i, a in prints.items() for j, b in prints.items() if i <= j and (a ^ b).bit_count() <= 2)
    for r in run(spark, sf_dir, "op4_simhash_near_dedup"):
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", links[r.doc_id])


def test_bpe(spark, sf_dir, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in run(spark, sf_dir, "op5_bpe"):
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_token_frames(spark, sf_dir, texts):
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    out = {r.doc_id: r for r in run(spark, sf_dir, "op6_token_frames")}
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert tuple(out[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_counts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import tiktoken

    from visitgrain.llm.token_counts import _encoding

    many: tiktoken.Encoding = _encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    seen, want = set(), defaultdict(lambda: [0, 0])
    for r in rows:
        if (r.text or "") in seen:
            continue
        seen.add(r.text or "")
        version = "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k"
        n = len(one.encode(r.text or "", add_special_tokens=False).ids) if r.lang == "en" else len(many.encode_ordinary(r.text or ""))
        total = want[r.source, r.lang, version]
        total[0] += 1
        total[1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in run(spark, sf_dir, "op10_token_counts")}
    assert got == want


def test_whitening(spark, sf_dir):
    from test_whitening import check

    rows = [(r.vec_id, list(r.embedding)) for r in read_table(spark, sf_dir, "embeddings").collect()]
    check(rows, run(spark, sf_dir, "op12_embedding_whitening"))
