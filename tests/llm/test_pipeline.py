"""The pipeline's rows beside a plain Python form of the same decisions."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_decontaminate import brute as contained
from test_simhash import roots
from tokenizers import Tokenizer

import corpus_pipeline
from visitgrain.llm import pii, quality
from visitgrain.llm.common import read_table
from visitgrain.llm.queries import GOOD, held_out


def jaccard(a, b):
    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding",
    ]


def test_rows_equal_plain_decisions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    score = quality.scorer(model)
    texts = {r.doc_id: r.text or "" for r in docs.collect() if score(r.text or "") >= GOOD}

    named = list(texts)
    links = roots((i, j) for i in named for j in named if i <= j and jaccard(texts[i], texts[j]) >= 0.8)
    groups = defaultdict(list)
    for i in texts:
        groups[links[i]].append(i)
    texts = {min(g): texts[min(g)] for g in groups.values()}

    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    bad = {d for d, *_ in contained(list(texts.items()), items)}
    texts = {i: pii.redact(t) for i, t in texts.items() if i not in bad}
    assert bad and groups

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want[i] = (i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest(), raw)
    got = {r.doc_id: (*r[:4], bytes(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_odd_rows_pass_every_stage(spark, sf_dir, documents, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "no id"), (2, "again"), (2, "again")]
    for docs in (documents(rows), documents([])):
        kept = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= kept
            if name != "BPE encoding and decoding":
                assert out.columns == list(corpus_pipeline.COLUMNS)
