import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from visitgrain.llm import token_frames

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_equal_the_library(library, odd_texts):
    texts = [t or "" for t in odd_texts] + ["a  b", " a", "a ", "a   b \n c", "x <|endoftext|> y", "a  b", "\n \n x", "I'm  here 'll"]
    coder = token_frames.PieceEncoder(PATH)
    for _ in range(2):  # the second time from the table
        for text, ids in zip(texts, coder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, documents, folder, odd_texts, library):
    rows = [(7 * i % 31, t) for i, t in enumerate(odd_texts)] + [(None, "null id"), (3, "again"), (3, "again")]
    where = folder("tokens")
    manifest = token_frames.write_frames(documents(rows), spark, where, PATH, file_bytes=20_000)
    assert manifest.count() > 1
    got = sorted(token_frames.read_frames(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    assert sorted(np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got) == sorted(want_ids(library, t) for _, t in rows)
    some = token_frames.read_documents(manifest, [3, 7]).collect()
    assert sorted(r.doc_id for r in some) == sorted(i for i, _ in rows if i in (3, 7))
    # A plain decoder reads the frames as one stream and skips the table.
    for name in glob.glob(f"{where}/*.zst"):
        held = token_frames.FrameFile(name)
        assert held.width == 2
        whole = b"".join(held.document(p).astype("<u2").tobytes() for p in range(len(held)))
        with open(name, "rb") as f:
            assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == whole


def test_wide_ids(spark, documents, folder, library):
    manifest = token_frames.write_frames(documents(["some words"]), spark, folder("w"), PATH, end_id=70_000)
    assert token_frames.FrameFile(manifest.first().file).width == 4
    ids = np.frombuffer(bytes(token_frames.read_frames(manifest).first().ids), "<u4").tolist()
    assert ids == [*want_ids(library, "some words")[:-1], 70_000]


def test_damage_is_noticed(spark, documents, folder):
    manifest = token_frames.write_frames(documents(["some text to be kept"]), spark, folder("t"), PATH)
    name = manifest.first().file
    raw = bytearray(open(name, "rb").read())
    end = len(raw) - 9 - 12
    raw[end + 8] ^= 1  # the checksum in the seek table
    open(name, "wb").write(bytes(raw))
    with pytest.raises(ValueError, match="checksum"):
        token_frames.FrameFile(name).document(0)


def test_empty_table(spark, documents, folder):
    manifest = token_frames.write_frames(documents([]), spark, folder("none"), PATH)
    assert manifest.collect() == [] and token_frames.read_frames(manifest).collect() == []
