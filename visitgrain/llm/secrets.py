"""Secret scan: keyword automaton, regular expressions anchored at its hits, checksum validation.

One pass of an Aho-Corasick automaton over a text finds every place where a secret can begin: the
keywords of assignments, the prefixes of known token formats, and four hexadecimal digits in a
row. A regular expression is tried only there. Formats with an embedded checksum are reported when
the checksum holds.

Kinds, in the order used for ties:

* ``assign``, ``access``, ``hex``: the base kinds, leftmost and non-overlapping within a kind; a
  match that is too short is dropped and not tried again at a later start;
* ``github``, ``npm``: prefix, 30 letters or digits, and their CRC-32 as six base-62 digits;
* ``xprv``: an extended private key in base 58 whose last four bytes are the double SHA-256.

Defined results: a null or empty text has no spans; repeated rows are scanned each for itself;
offsets are code points, end exclusive; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from visitgrain.llm.common import scan, texts_of, type_of

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])")

_LEAST_ASSIGN, _LEAST_ACCESS, _LEAST_HEX = 6, 20, 24
_HEX_DIGITS = "0123456789abcdef"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    """Values are (kind's number, keyword's length); keywords are in lower case."""
    found = ahocorasick.Automaton()
    for four in product(_HEX_DIGITS, repeat=4):
        found.add_word("".join(four), (2, 4))
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        found.add_word(word, (0, len(word)))
    found.add_word("akia", (1, 4))
    for letter in "pousr":
        found.add_word(f"gh{letter}_", (3, 4))
    found.add_word("npm_", (4, 4))
    found.add_word("xprv", (5, 4))
    found.make_automaton()
    return found


def _crc62_holds(m: re.Match) -> bool:
    value, digits = zlib.crc32(m[1].encode()), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(_BASE62[digit])
    return m[2] == "".join(reversed(digits))


def _base58_holds(m: re.Match) -> bool:
    value = 0
    for c in m[0]:
        value = value * 58 + _BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: By kind's number: the expression, and what a match must also satisfy.
_RULES = (
    (_ASSIGN, lambda m: m.end(2) - m.start(2) >= _LEAST_ASSIGN),
    (_ACCESS, lambda m: m.end() - m.start() >= _LEAST_ACCESS),
    (_HEX, lambda m: m.end() - m.start() >= _LEAST_HEX),
    (_GITHUB, _crc62_holds),
    (_NPM, _crc62_holds),
    (_XPRV, _base58_holds),
)


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, kind's number, end), sorted."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # one letter whose lower case is two
        low = text.translate(_ASCII_LOWER)
    after = [0] * len(KINDS)
    spans = []
    for last, (kind, length) in _automaton().iter(low):
        start = last - length + 1
        if start < after[kind]:
            continue
        expression, holds = _RULES[kind]
        m = expression.match(text, start)
        if m:
            after[kind] = m.end()
            if holds(m):
                spans.append((start, kind, m.end()))
    spans.sort()
    return spans


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``secrets``, an array of (kind, start, end, value)."""

    def start():
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
        )

        def work(ids, texts):
            found = [
                [{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in find_secrets(t)]
                for t in texts_of(texts)
            ]
            return {id_col: ids, "secrets": (found, kind)}

        return work

    return scan(
        docs,
        [id_col, text_col],
        start,
        {
            id_col: type_of(docs, id_col),
            "secrets": "array<struct<kind: string, start: int, end: int, value: string>>",
        },
    )
