"""Encoding texts by way of their distinct pieces, column-wise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces at which a Python worker's recent table becomes the older one; the one before goes.
KEPT = 1 << 19
#: Characters of text that are handled together.
TOGETHER = 4 << 20


class PieceTable:
    """Ids of pieces, as bytes, remembered within bounds. It changes the time only, never a result."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.make, self.kept = make, kept
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.recent) >= self.kept:
            self.older, self.recent = self.recent, {}
        found = list(map(self.recent.get, pieces))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        for i in lacking:
            found[i] = self.older.get(pieces[i])
        fresh = [i for i in lacking if found[i] is None]
        for i, ids in zip(fresh, self.make([pieces[i] for i in fresh])):
            found[i] = ids
        self.recent.update((pieces[i], found[i]) for i in lacking)
        return found


def joined(offsets: np.ndarray, index: np.ndarray, ids: list[bytes]) -> list[bytes]:
    """For each list of pieces (``index`` between ``offsets``) its pieces' ids one after the other."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    start = size.cumsum() - size
    n = size[index]
    ends = np.concatenate(([0], n.cumsum()))
    at = np.repeat(start[index] - ends[:-1], n)
    at += np.arange(len(at))
    raw = flat[at].tobytes()
    bounds = (ends[offsets] * 4).tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def distinct(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of the lists, each piece's number, and the distinct pieces."""
    offsets = lists.offsets.to_numpy()
    coded = pc.dictionary_encode(lists.flatten())
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def together(texts: list[str], most: int = TOGETHER) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters at most, or of one longer text."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > most:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run
