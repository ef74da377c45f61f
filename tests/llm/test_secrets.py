import random
import re
import zlib

import pytest

from visitgrain.llm import secrets

KINDS = [
    (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def brute(text):
    return sorted(
        (m.start(), k, m.end()) for k, (p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m)
    )


def base(text):
    return [s for s in secrets.find_secrets(text) if s[1] < 3]


def with_crc(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = secrets._BASE62[d] + digits
    return prefix + body + digits


def test_base_spans_equal_plain_expressions():
    rng = random.Random(1)
    parts = """password Passwd SECRET token toKen api_key APIKEY secretoken = : ' " abcdef 0123456789abcdef AKIA
    ABCDEFGH12345678 x deadbeef é İ . -""".split() + [" ", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base(text) == brute(text), text


def test_base_spans_of_odd_texts(odd_texts):
    for text in odd_texts:
        assert base(text) == brute(text)


@pytest.mark.parametrize("prefix,kind", [("ghp_", 3), ("gho_", 3), ("npm_", 4)])
def test_checksum_decides(prefix, kind):
    good = with_crc(prefix, "aB3" * 10)
    assert (4, kind, 4 + len(good)) in secrets.find_secrets(f"see {good} here")
    broken = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert not [s for s in secrets.find_secrets(f"see {broken} here") if s[1] == kind]


def test_extended_key_checksum():
    import hashlib

    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    value, text = int.from_bytes(raw, "big"), ""
    while value:
        value, d = divmod(value, 58)
        text = secrets._BASE58[d] + text
    assert text.startswith("xprv") and len(text) == 111
    assert (0, 5, 111) in secrets.find_secrets(text)
    assert not [s for s in secrets.find_secrets(text[:-1] + ("1" if text[-1] != "1" else "2")) if s[1] == 5]


def test_frames(documents, odd_texts):
    out = {r.doc_id: r.secrets for r in secrets.scan_secrets(documents([*odd_texts, "token = abcdef1"])).collect()}
    assert len(out) == len(odd_texts) + 1 and out[0] == [] and out[1] == []
    assert [(s.kind, s.start, s.end, s.value) for s in out[len(odd_texts)]] == [("assign", 0, 15, "token = abcdef1")]
    assert secrets.scan_secrets(documents([])).collect() == []
    rows = secrets.scan_secrets(documents([(None, "secret=abcdefg"), (5, "x"), (5, "x")])).collect()
    assert sorted(((r.doc_id is None, len(r.secrets)) for r in rows)) == [(False, 0), (False, 0), (True, 1)]
