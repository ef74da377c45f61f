import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from visitgrain.llm import bpe, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def fuzz(n, seed=3):
    rng = random.Random(seed)
    letters = "aé ÉİǅßſK'sn'tIl\t\n\x0b\x1c\x85\xa0 　́漢字१²½٣!?<|endoftext|>_-Σς ΑΣ ﬁ\x00😀‍"
    parts = [*letters, *letters, "<|endoftext|>", "<|startoftext|>", "don't", "WE'LL ", "internationalization"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_equals_the_library(library, odd_texts):
    texts = [t or "" for t in odd_texts] + fuzz(3000) + ["ab" * 4000, "<|ENDOFTEXT|>", "don't" * 30]
    coder = bpe.WordEncoder(PATH)
    for text, ids in zip(texts, coder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_tables_change_no_result(library, monkeypatch):
    monkeypatch.setattr(pieces, "TOGETHER", 40)
    coder = bpe.WordEncoder(PATH)
    coder.table.kept = 5
    texts = [f"word{i} {t}" for i, t in enumerate(fuzz(200, 9))]
    for low in range(0, 200, 7):
        for text, ids in zip(texts[low : low + 7], coder.encode(texts[low : low + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_and_short_merges_agree():
    coder, rng = bpe.WordEncoder(PATH), random.Random(8)
    for n in (2, 5, 20, 63, 64):
        raw = bytes(rng.choice(b"theinandre") for _ in range(n))
        parts = coder.inner[np.frombuffer(raw, np.uint8)]
        short = bpe.merge_words(parts[None, :], np.array([n]), coder.ranks)[0]
        assert short[short >= 0].tolist() == bpe.merge_long_word(parts.tolist(), coder.ranks)


def test_frames(spark, documents, odd_texts, library):
    docs = documents(odd_texts)
    made = bpe.encode_documents(docs, PATH)
    rows = {r.doc_id: r for r in made.collect()}
    for i, text in enumerate(odd_texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(want, "<u4").tobytes()
        assert (rows[i].n_tokens, bytes(rows[i].ids)) == (len(want), raw)
        assert rows[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(rows[i].decoded.encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode_documents(made, PATH).collect()}
    assert back == {i: r.decoded for i, r in rows.items()}
    assert bpe.encode_documents(documents([]), PATH).collect() == []
    assert len(bpe.encode_documents(documents([(1, "a"), (1, "a"), (None, None)]), PATH, whole=False).collect()) == 3
