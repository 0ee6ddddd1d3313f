import random

import pytest

from carelens.llm.tables import ship

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with extra columns whose names clash."""
    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2:])[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "k") for r in full], DOC_SCHEMA)
    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose: prose(seed, n_words)."""
    def make(seed, n):
        r = random.Random(seed)
        parts = ["ka", "lo", "mi", "ter", "un", "sa", "vel", "or", "pin", "qua", "zu", "den"]
        vocab = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(600)]
        return " ".join(r.choice(vocab) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    return make
