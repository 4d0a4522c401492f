from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from odd_tables import frame, words  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows and ids, signs outside ASCII."""
    plain = " ".join(words(1, 80))
    return [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, plain, "en", "a"),
        (5, plain.upper(), "fr", "b"), (6, plain + " more", "en", "b"), (6, plain + " more", "en", "b"),
        (7, "one two", "en", "a"), (8, "ONE\ttwo", "en", None), (None, plain, None, None), (None, None, None, None),
        (9, " ".join(words(2, 60_000)), "de", "b"), (10, "ééé ß 中文 \U0001F600 x", "fr", ""),
        (11, "A" * 3_000 + "@" + "1" * 3_000 + " " + ". - " * 20_000, "en", "a"),
        (12, " ".join(words(3, 40)), "en", "a"), (12, " ".join(words(4, 40)), "en", "a"), (13, " ".join(words(3, 40)), "en", "c"),
        (14, "same same same same same same same", "en", "a"),
    ]


@pytest.fixture
def odd_docs(spark, odd_rows):
    return frame(spark, odd_rows)
