import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size string, taken int, print string, key string, row string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null, empty, blank, very long, repeated and near-equal texts; null ids and sources; repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 20_000, 5_000)
    passage = prose(rng, 80)
    base = prose(rng, 300)
    near = base.replace("w1", "x1", 1)
    texts = [
        (0, None, "a"), (1, "", "a"), (2, " \t\n\r\x0b\x0c ", "b"), (3, long, "a"), (4, base, "a"), (5, base, None), (6, near, "b"),
        (7, prose(rng, 90) + " " + passage, "a"), (8, passage + " " + prose(rng, 70), "c"), (9, prose(rng, 20) + " " + passage + "\n" + prose(rng, 30), "c"),
        (10, "one", "a"), (11, "one", "a"), (12, "ONE two", None), (13, "Äpfel ñandú ß 漢字 😀 w1 w2", "a"), (14, "ha " * 300, "b"),
        (15, base.upper(), "b"), (16, "tab\tand\x0bvertical stay wide", "b"), (None, base, "a"), (None, None, None),
        (17, "repeat " + passage, "a"), (17, "repeat " + passage, "a"),
    ]
    texts += [(100 + i, prose(rng, rng.randrange(1, 120)), rng.choice("abc")) for i in range(40)]
    return [(i, t, "en", s, None if t is None else len(t), "x", "y", 9, "p", "k", "r") for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
