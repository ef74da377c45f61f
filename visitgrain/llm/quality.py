"""Quality score from compression with two dictionaries.

One zstandard dictionary is built from windows of texts labelled good, another from texts labelled
bad. A text is compressed window by window with each: the dictionary whose kind of text it
resembles makes it smaller. The normalised difference of the two sizes, over the whole text and in
its worst window, together with the compressed size per byte, becomes a score by logistic
calibration on other labelled rows.

What is learned comes from a bounded sample: of each class about ``rows`` labelled documents for
the dictionary and as many for the calibration, those with the id's hash under a share, and at most
``WINDOWS`` windows of each document, spread over its whole text. Calibration weights undo the
sampling, so a score is a probability in the labelled rows' own proportions. Scoring covers every
byte of every text.

Defined results: a null or empty text is one empty window and gets the score of its features;
labels that are null or contradict each other for one id are not learned; without any label every
score is 0.5, and with labels of one class only it is the share (n1 + 1) / (n + 2); where an id
repeats, each row is scored for itself; other columns of the input are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.llm.common import pick, scan, texts_of, type_of

WINDOW = 1024
DICTIONARY = 64 * 1024
LEVEL = 3
WINDOWS = 8
#: Windows shorter than this say little alone; they count in the whole, not as the worst window.
LEAST = 200
MILLION = 1_000_000


@dataclass(frozen=True)
class QualityModel:
    """``good`` and ``bad`` are dictionaries; without ``weights`` the score is ``prior``."""

    good: bytes = b""
    bad: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5
    sampled: dict = field(default_factory=dict, compare=False)


def _windows(raw: bytes) -> list[bytes]:
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)] or [b""]


def _features_with(good: bytes, bad: bytes) -> Callable[[str], list[float]]:
    def compressor(raw: bytes) -> zstandard.ZstdCompressor:
        plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        if not raw:
            return zstandard.ZstdCompressor(**plain)
        trained = zstandard.ZstdCompressionDict(raw)
        trained.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=trained, **plain)

    with_good, with_bad = compressor(good).compress, compressor(bad).compress

    def features(text: str) -> list[float]:
        raw = text.encode("utf-8", "replace")
        parts = _windows(raw)
        g = np.array([len(with_good(p)) for p in parts], float)
        b = np.array([len(with_bad(p)) for p in parts], float)
        n = np.array([len(p) for p in parts], float)
        smaller = np.minimum(g, b)
        telling = n >= min(LEAST, n.max())
        return [
            (b.sum() - g.sum()) / smaller.sum(),
            float(((b - g) / smaller)[telling].min()),
            float(smaller.sum() / max(len(raw), 1)),
            float((smaller / n.clip(1))[telling].min()),
            float(1 / np.log(2 + len(raw))),
        ]

    return features


def _dictionary(windows: list[bytes]) -> bytes:
    """A trained dictionary; of few windows, which can't be trained on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, windows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-DICTIONARY:]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple, tuple, tuple]:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), 1e-2
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge * w
        curve = z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max() / 5)
    return tuple(centre.tolist()), tuple(scale.tolist()), tuple(w.tolist())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    rows: int = 3000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Learn from labelled rows for which ``learn``, a condition on the id, holds."""
    known = pick(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if learn is not None:
        known = known.where(learn)
    known = (
        known.groupBy(id_col)
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("other"))
        .where("y = other")
        .select(F.col(id_col).alias("id"), "y", F.xxhash64(id_col).alias("h"))
        .select("id", "y", F.pmod("h", F.lit(2)).alias("part"), F.pmod(F.shiftright("h", 1), F.lit(MILLION)).alias("place"))
    )
    counts = {(r.y, r.part): r.n for r in known.groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    n = [sum(c for (y, _), c in counts.items() if y == v) for v in (0, 1)]
    if not all(n):
        return QualityModel(prior=(n[1] + 1) / (sum(n) + 2))
    # About ``rows`` ids of each class and part: those whose hash falls under their share.
    under = F.lit(False)
    for (y, part), count in counts.items():
        share = min(MILLION, -(-rows * MILLION // count))
        under = under | ((F.col("y") == y) & (F.col("part") == part) & (F.col("place") < share))
    chosen = known.where(under).select("id", "y", "part")
    texts = (
        pick(docs, id_col, text_col)
        .join(F.broadcast(chosen), F.col(id_col) == F.col("id"))
        .groupBy("id", "y", "part")
        .agg(F.min(F.coalesce(text_col, F.lit(""))).alias("words"))
    )

    def spread():
        def work(ids, y, words):
            taken = []
            for text in texts_of(words):
                parts = _windows(text.encode("utf-8", "replace"))
                places = {round(k * (len(parts) - 1) / max(WINDOWS - 1, 1)) for k in range(WINDOWS)}
                taken.append([parts[k] for k in sorted(places)])
            return {"id": ids, "y": y, "windows": (taken, pa.list_(pa.binary()))}

        return work

    out = {"id": type_of(texts, "id"), "y": "int", "windows": "array<binary>"}
    typed = texts.withColumn("y", F.col("y").cast("int"))
    samples = scan(typed.where("part = 0"), ["id", "y", "words"], spread, out).collect()
    samples.sort(key=lambda r: (r.y, r.id))
    bad, good = (
        _dictionary([bytes(w) for r in samples if r.y == v for w in r.windows if len(w) >= 16]) for v in (0, 1)
    )

    def measure():
        features = _features_with(good, bad)

        def work(ids, y, words):
            return {"id": ids, "y": y, "x": ([features(t) for t in texts_of(words)], pa.list_(pa.float64()))}

        return work

    out = {"id": type_of(texts, "id"), "y": "int", "x": "array<double>"}
    measured = sorted(scan(typed.where("part = 1"), ["id", "y", "words"], measure, out).collect(), key=lambda r: r.id)
    y = np.array([r.y for r in measured], float)
    if len(set(y.tolist())) < 2:
        return QualityModel(prior=(n[1] + 1) / (sum(n) + 2))
    share = np.where(y == 1, n[1] / sum(n) / y.mean(), n[0] / sum(n) / (1 - y.mean()))
    return QualityModel(
        good,
        bad,
        *_calibrate(np.array([r.x for r in measured]), y, share),
        sampled={"labelled": n, "dictionary": len(samples), "calibration": len(measured)},
    )


def scorer(model: QualityModel) -> Callable[[str], float]:
    if not model.weights:
        return lambda text: model.prior
    features = _features_with(model.good, model.bad)
    centre, scale, weights = (np.array(x) for x in (model.centre, model.scale, model.weights))

    def score(text: str) -> float:
        z = ((np.array(features(text)) - centre) / scale) @ weights[:-1] + weights[-1]
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)

    return score


def score_documents(
    docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``keep`` columns and ``score``, 0 to 1, higher for text like that labelled good."""
    kept = [c for c in keep if c not in (text_col, "score")]

    def start():
        of = scorer(model)

        def work(texts, *rest):
            out = {"score": ([of(t) for t in texts_of(texts)], pa.float64()), **dict(zip(kept, rest))}
            return out | {text_col: texts}

        return work

    out = {c: "string" if c == text_col else type_of(docs, c) for c in keep if c != "score"} | {"score": "double"}
    return scan(docs, [text_col, *kept], start, out)
