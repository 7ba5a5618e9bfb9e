import random

import pytest

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(6000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, rank int, __s string, spans string"


@pytest.fixture(scope="session")
def vocabulary():
    r = random.Random(11)
    return ["".join(r.choices("etaoinshrdlucmfwypvbgk", weights=range(24, 2, -1), k=r.randint(2, 9))) for _ in range(4000)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, and columns whose names operators use themselves."""
    p = prose(1, 120)
    rows = [
        (1, p, "en", "a"), (2, p, "en", "a"), (2, p, "en", "a"), (3, "", "en", None), (4, None, None, "b"), (None, p, "de", "b"), (5, "   \n\t ", "de", "c"),
        (6, LONG, "en", "a"), (7, "Ünïcödé ñ 😀 token = \"0123456789abcdef0123456789abcdef\" " + prose(2, 80), "de", "c"), (8, "x", None, "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), None, "no", None, "s", "x") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd_docs):
    return odd_docs.limit(0)
