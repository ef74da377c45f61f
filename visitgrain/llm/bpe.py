"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word is held as two arrays side by side: its parts, and the merge rank of each part with the
next. The least rank is found by scanning the array; its right boundary is deleted, and only the
two neighbouring ranks are looked up again. Words of like length are stacked as rows of one matrix,
so that a step of the loop is one step of every word that still has a merge. For words of more than 64
bytes, where repeated scans would cost the square of the length, a heap over the same
arrays gives the same merges.

Text goes through the vocabulary file's own steps: special tokens are cut out of the raw text,
the rest is composed (NFC), runs of white space become one space, letters are lower-cased, words
are split by the file's pattern, and bytes are written in the file's byte alphabet. Texts whose
letters lie below U+0250 pass a plain form of these steps that gives the same result; others use
the library's normaliser, so that its tables decide.

Pieces between spaces repeat, so their ids are kept in a table of bounded size. The table changes
the time only, never a result.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each for itself; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from visitgrain.llm.common import scan, texts_of, type_of
from visitgrain.llm.pieces import PieceTable, distinct, joined, together

#: Bounds of word lengths in bytes that share a matrix; longer words are merged with a heap.
WIDTHS = (0, 6, 10, 14, 20, 32, 64)
NO_RANK = 1 << 40

#: White space of plain texts, beside the space.
_WHITE = "\t\n\x0b\x0c\r\x85\xa0"
_PLAIN_TEXT = regex.compile(r"[^\u0250-\U0010ffff\x1c-\x1f\u0130]*+")


class Ranks:
    """Merge ranks of pairs of parts, looked up for whole arrays at once."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """``pairs``: left part, right part, part that the merge makes, in order of rank."""
        left, right, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.of = dict(zip(zip(left.tolist(), right.tolist()), range(len(pairs))))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NO_RANK)


def merge_words(parts: np.ndarray, count: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Merge the parts of many short words, least rank first and leftmost among equals.

    ``parts`` has a word's parts in each row, the rest of the row is -1; ``count`` is their number.
    Returns the merged rows in the same form.
    """
    done = np.full_like(parts, -1)
    row, parts = np.arange(len(parts)), parts.copy()
    if parts.shape[1] < 2:
        return parts
    rank = np.where(parts[:, 1:] >= 0, ranks.look_up(parts[:, :-1], parts[:, 1:].clip(0)), NO_RANK)
    column = np.arange(parts.shape[1] - 1)
    while len(row):
        here = np.arange(len(row))
        at = rank.argmin(axis=1)
        least = rank[here, at]
        ended = least == NO_RANK
        if ended.any():
            done[row[ended]] = parts[ended]
            live = ~ended
            row, parts, rank, count, at, least = (x[live] for x in (row, parts, rank, count, at, least))
            here = np.arange(len(row))
        new = ranks.made[least]
        parts[here, at] = new
        count = count - 1
        # Delete the boundary: what stands right of it moves one place to the left.
        parts[:, 1:-1] = np.where(column[None, :-1] >= at[:, None], parts[:, 2:], parts[:, 1:-1])
        parts[:, -1] = -1
        rank[:, :-1] = np.where(column[None, :-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
        rank[:, -1] = NO_RANK
        some = at > 0
        rank[here[some], at[some] - 1] = ranks.look_up(parts[here[some], at[some] - 1], new[some])
        some = at + 1 < count
        rank[here[some], at[some]] = ranks.look_up(new[some], parts[here[some], at[some] + 1])
    return done


def merge_long_word(parts: list[int], ranks: Ranks) -> list[int]:
    """The same merges for a long word: a heap of (rank, place), and links over deleted places."""
    n, ranks_of, made = len(parts), ranks.of, ranks.made
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks_of[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks_of]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = int(made[rank]), -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n:
                pair = (parts[left], parts[after[left]])
                if pair in ranks_of:
                    heapq.heappush(heap, (ranks_of[pair], left, *pair))
    return [p for p in parts if p >= 0]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others
    for letters from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Encodes and decodes with a vocabulary of words that end in a mark.

    ``path`` is a file of the tokenizers library holding a byte-pair model with an end-of-word
    suffix, the pattern that splits words, and no decoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.words = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.ranks = Ranks([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        names = {i: c for c, i in vocab.items()} | {i: c for c, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        # A Python worker outlives its stage, and what it holds counts for the stages that follow.
        self.table = PieceTable(self._make, kept=1 << 18)

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        out: dict[str, bytes] = {}
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            those = np.flatnonzero((length > low) & (length <= high)).tolist()
            if not those:
                continue
            n = length[those]
            flat = np.frombuffer(b"".join([raw[i] for i in those]), np.uint8)
            parts = np.full((len(those), high), -1, np.int64)
            parts[np.arange(high) < n[:, None]] = self.inner[flat]
            parts[np.arange(len(those)), n - 1] = self.final[flat[n.cumsum() - 1]]
            merged = merge_words(parts, n, self.ranks)
            held = merged >= 0
            ends = (held.sum(axis=1).cumsum() * 4).tolist()
            ids = merged[held].astype("<u4").tobytes()
            for i, start, end in zip(those, [0, *ends], ends):
                out[words[i]] = ids[start:end]
        for i in np.flatnonzero(length > WIDTHS[-1]).tolist():
            parts = self.inner[np.frombuffer(raw[i], np.uint8)].tolist()
            parts[-1] = int(self.final[raw[i][-1]])
            out[words[i]] = np.array(merge_long_word(parts, self.ranks), "<u4").tobytes()
        return out

    def _make(self, pieces: list[str]) -> list[bytes]:
        parted = [self.words.findall(p) for p in pieces]
        made = self._words(list({w for words in parted for w in words}))
        return [b"".join([made[w] for w in words]) for words in parted]

    def _normal(self, text: str) -> str:
        """A text without special tokens, normalised; pieces stand between spaces."""
        if not _PLAIN_TEXT.fullmatch(text):
            return self.normalizer.normalize_str(text)
        text = text.lower()
        for white in _WHITE:
            if white in text:
                text = text.replace(white, " ")
        return text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for run in together(texts) for ids in self._run(run)]

    def _run(self, texts: list[str]) -> list[bytes]:
        parts, marks = [], []  # plain stretches of all texts; for each text its stretches and special ids
        for text in texts:
            own, at = [], 0
            for m in self.cut.finditer(text) if "<|" in text else ():
                own += [None, np.array([self.special[m[0]]], "<u4").tobytes()]
                parts.append(self._normal(text[at : m.start()]))
                at = m.end()
            parts.append(self._normal(text[at:] if at else text))
            marks.append([*own, None])
        offsets, index, pieces = distinct(pc.split_pattern(pa.array(parts, pa.string()), " "))
        made = iter(joined(offsets, index, self.table.ids(pieces)))
        return [b"".join([next(made) if mark is None else mark for mark in own]) for own in marks]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, special ones included, as the file has no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True
) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, where
    ``whole``, the ``ids`` (binary, little-endian unsigned 32-bit) and the ``decoded`` text.

    ``path`` is the vocabulary file, installed at the same place on every executor.
    """

    def start():
        coder = encoder(path)
        hexed = lambda raw: hashlib.sha256(raw).hexdigest()

        def work(ids, texts):
            made = coder.encode(texts_of(texts))
            back = [coder.decode(m) for m in made]
            out = {
                id_col: ids,
                "n_tokens": ([len(m) // 4 for m in made], pa.int64()),
                "ids_sha256": (list(map(hexed, made)), pa.string()),
                "decoded_sha256": ([hexed(b.encode()) for b in back], pa.string()),
            }
            if whole:
                out |= {"ids": (made, pa.binary()), "decoded": (back, pa.string())}
            return out

        return work

    out = {
        id_col: type_of(docs, id_col),
        "n_tokens": "bigint",
        "ids_sha256": "string",
        "decoded_sha256": "string",
    } | ({"ids": "binary", "decoded": "string"} if whole else {})
    return scan(docs, [id_col, text_col], start, out, rows=1024)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per encoded document: id and the ``decoded`` text; null ids decode to the empty text."""

    def start():
        coder = encoder(path)

        def work(ids, made):
            return {id_col: ids, "decoded": ([coder.decode(m or b"") for m in made.to_pylist()], pa.string())}

        return work

    return scan(encoded, [id_col, ids_col], start, {id_col: type_of(encoded, id_col), "decoded": "string"})
