import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, salt int"


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows, with columns that clash with internal names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), 7, "k", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def prose():
    """Seeded sentences of invented words."""

    def make(seed, words):
        rng = random.Random(seed)
        parts = ["the", "of", "ra", "ti", "on", "ea", "sh", "nd", "ble", "wh", "ly", "é", "st"]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words))

    return make
