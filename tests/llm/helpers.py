"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa", "no", "vi") for b in ("ran", "del", "pos", "tim", "gu", "", "x")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, first_id=0, extra=False):
    rows = [(first_id + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns whose names an operator might use itself
        from pyspark.sql import functions as F

        for c in ("size", "length", "piece", "score", "spans", "node", "part", "key", "n", "tree", "component", "label"):
            df = df.withColumn(c, F.lit("x"))
    return df


ODD = ["", None, "one", "  \t\n ", "a\x0bb\x85c", "é" * 50, "same text here", "same text here", "x " * 40_000]
