import random

import pytest

WORDS = [a + b + c for a in ("th", "re", "on", "sh") for b in ("a", "e", "io") for c in ("nd", "r", "ble", "st")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, and columns whose names operators use inside."""
    long = "\n".join(prose(i, 40) for i in range(400))
    rows = [
        (1, "alpha beta", "en"), (2, "alpha  \t beta", "en"), (3, "alpha beta", None), (4, None, "en"), (5, "", "de"), (6, " \n ", "de"),
        (7, long, "en"), (8, long + " end", "en"), (9, long, "fr"), (None, "no id", "en"), (None, "no id", "en"), (None, None, None),
        (10, "same row", "en"), (10, "same row", "en"), (11, prose(1, 80), "en"), (12, prose(2, 80) + " x y 你好 🙂 ▁", "en"), (0, "12 34 !?", None),
    ]
    full = [(i, t, g, "s", None if t is None else len(t), 1, "r", 2, "k", 3.0, [1], 4) for i, t, g in rows]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, row string, size int, key string, score double, spans array<int>, _doc int"
    return spark.createDataFrame(full, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
