"""Personal data: expressions propose spans, checksums confirm them, context words adjust a score.

Kinds, in the order used for ties:

* ``email``, ``ip``, ``card``, ``phone``: the base kinds, leftmost and non-overlapping within a
  kind; a match that fails its test (parts at most 255; 12 to 19 digits passing Luhn; 9 to 15
  digits) is dropped and not tried again at a later start. These spans are always reported;
* ``iban``: two letters, two check digits and 11 to 30 letters or digits, in one piece or in groups
  of four, with remainder 1 modulo 97;
* ``ssn``: ddd-dd-dddd with possible numbers. It has no checksum, so it is reported only where
  context words lift its score.

A span's score starts from its kind's prior, which a passed checksum raises; a supporting word
within ``WINDOW`` code points on either side adds to it, an opposing word takes away. The added
kinds need ``LEAST_SCORE``; redaction takes every span of at least its own ``least`` argument.

Every expression takes time in proportion to the text, whatever the text.

Defined results: a null or empty text has no spans; repeated rows are searched each for itself;
offsets are code points, end exclusive; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from visitgrain.llm.common import scan, texts_of, type_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
WINDOW = 48
LEAST_SCORE = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these ends where its run of digits ends, so no later one can start inside a run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Prior score, with a passed checksum where the kind has one.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
_FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|reach|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|client)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|cc)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|transfer|konto)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer|tin)\b"),
}
_AGAINST = {
    "ip": re.compile(r"(?i)\b(?:version|release|build|section|chapter)\b"),
    "card": re.compile(r"(?i)\b(?:isbn|serial|tracking|invoice|sku)\b"),
    "ssn": re.compile(r"(?i)\b(?:part|serial|tracking|model|isbn)\b"),
}
_STEP = 0.3
_NOT_DIGITS = {c: None for c in map(ord, " -().+")}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mod97(text: str) -> bool:
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str):
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        # Without a match the run left of this sign ends here: it can't be part of a later one.
        after = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", after)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _ips(text: str):
    return (m.span() for m in _IP.finditer(text) if all(map(_small, m.groups())))


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].translate(_NOT_DIGITS)
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    return (m.span() for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(_NOT_DIGITS)) <= 15)


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    score = _PRIOR[kind]
    if _FOR[kind].search(around):
        score += _STEP
    if kind in _AGAINST and _AGAINST[kind].search(around):
        score -= _STEP
    return round(min(max(score, 0.0), 1.0), 3)


def find_pii(text: str | None) -> list[tuple[int, int, int, float]]:
    """Spans (start, kind's number, end, score), sorted."""
    if not text:
        return []
    spans = []
    base = (_emails(text) if "@" in text else (), _ips(text), _cards(text), _phones(text) if "+" in text else ())
    for k, found in enumerate(base):
        spans += [(start, k, end, _score(text, KINDS[k], start, end)) for start, end in found]
    for k, expression, holds in ((4, _IBAN, _mod97), (5, _SSN, bool)):
        for m in expression.finditer(text):
            if holds(m[0]) and (score := _score(text, KINDS[k], *m.span())) >= LEAST_SCORE:
                spans.append((m.start(), k, m.end(), score))
    spans.sort()
    return spans


def redact(text: str, least: float = LEAST_SCORE) -> str:
    """The text with each personal span replaced by its kind in brackets.

    Spans of the base kinds are replaced whatever their context says, others from score ``least``. Spans that overlap are replaced together, under the kind of the first.
    """
    out, at, until = [], 0, -1
    for start, k, end, score in find_pii(text):
        if k >= len(BASE_KINDS) and score < least:
            continue
        if start >= until:
            if until >= 0:
                at = until
            out += [text[at:start], f"[{KINDS[k].upper()}]"]
        until = max(until, end)
    return "".join(out) + text[until:] if until >= 0 else text


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``pii``, an array of (kind, start, end, score, value)."""
    kind = pa.list_(
        pa.struct(
            [
                ("kind", pa.string()),
                ("start", pa.int32()),
                ("end", pa.int32()),
                ("score", pa.float64()),
                ("value", pa.string()),
            ]
        )
    )

    def start():
        def work(ids, texts):
            found = [
                [
                    {"kind": KINDS[k], "start": s, "end": e, "score": p, "value": t[s:e]}
                    for s, k, e, p in find_pii(t)
                ]
                for t in texts_of(texts)
            ]
            return {id_col: ids, "pii": (found, kind)}

        return work

    return scan(
        docs,
        [id_col, text_col],
        start,
        {
            id_col: type_of(docs, id_col),
            "pii": "array<struct<kind: string, start: int, end: int, score: double, value: string>>",
        },
    )


def redact_documents(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", least: float = LEAST_SCORE
) -> DataFrame:
    """``keep`` columns with ``text_col`` redacted; a null text stays null."""
    others = [c for c in keep if c != text_col]

    def start():
        def work(texts, *rest):
            clean = [t and redact(t, least) for t in texts.to_pylist()]
            return {text_col: (clean, pa.string()), **dict(zip(others, rest))}

        return work

    return scan(docs, [text_col, *others], start, {text_col: "string", **{c: type_of(docs, c) for c in others}})
