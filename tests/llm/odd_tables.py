"""Builders of small tables for the tests of this folder."""

from __future__ import annotations

import random

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, key string, "
    "score double, taken long, pattern string, row long, band long, class string, hash long"
)


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("bdfklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def frame(spark, rows):
    """Documents with columns whose names operators might use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t), True, -1, "x", 0.5, -2, "p", 3, 4, "c", 5) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)
