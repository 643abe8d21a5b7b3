import random

import pytest

WORDS = "le la maison arbre soleil chemin parle avec tous les gens du village quand vient soir".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(40) if r.random() < 0.3 else "") for _ in range(n))


#: Column names that the operators use inside.
CLASHING = "score lang_pred n block part digest label row keys uid position tokens posterior rate domain media hits".split()


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    long = prose(1, 60_000)
    base = prose(2, 200)
    rows = [
        (0, base, "fr", "a", 5), (1, base, "fr", "a", 5), (2, base + " fin", "fr", None, None), (3, None, "fr", "a", 1), (4, "", None, "a", 0), (5, "!!! ... 123", "fr", "b", 1),
        (6, long, "fr", "b", len(long)), (7, long[1000:200_000], "en", "b", 3), (8, "é", "fr", "b", 1), (8, "é", "fr", "b", 1), (None, prose(3, 80), "fr", "c", 1),
        (2**60 + 1, prose(4, 120), "en", "c", 1), (10, "a b c", "en", "c", 1), (11, "a b c", "en", "c", 1), (12, "x" * 64, "en", "c", 64), (-5, prose(5, 30) + " \u0000 <|endoftext|>", "en", "c", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'clash' as {name}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
