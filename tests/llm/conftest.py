import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents of texts, or of (id, text) pairs, with extra columns whose names clash."""

    def make(rows, extra=True):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", None if k % 3 else "s", None) for k, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "fp", "shard", "old", "block", "items", "words", "id", "root", "size", "counts"):
                df = df.withColumn(name, F.lit("clash"))
            df = df.toDF(*df.columns).select("*", F.lit("other").alias("TEXT_2")).withColumnRenamed("TEXT_2", "Text")
        return df

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, repeated, control characters, other scripts, and very long texts."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "ζήτα", "漢字", "x1", "+49", "4111", "@", "="]
    long_text = " ".join(rng.choice(words) for _ in range(30000))
    return [
        None, "", " ", "\n\t", "a", "same text here", "same text here", "Σ ΑΣ İ ſ K ﬁ ½² ١", "\x00\x1c\x85  a　b",
        "x" * 50000, "@" * 3000, "1" * 20000, "+" * 2000, "a." * 3000 + "@", "😀 é ﻿", long_text,
    ]
