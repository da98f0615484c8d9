import random

import pytest

SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo xu".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, score double, rank int, `range` int"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rng = random.Random(1)
    base = " ".join(words(rng, 120))
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "fr", "b"),
        (6, "one two", "en", None), (7, "One TWO", "en", ""), (8, "all rights reserved. Released under the MIT License.", "en", "a"), (9, " ".join(words(rng, 30_000)), "fr", "c"),
        (10, "x" * 50_000, "de", "c"), (11, "漢字 ▁ 😀 naïve Æ\x00\x0b", "fr", "d"), (12, "12 34 !!", None, "d"), (None, "null id", "en", "a"), (14, "same row twice here now ok", "en", "a"),
        (14, "same row twice here now ok", "en", "a"), (-5, "negative id", None, "z"),
    ]
    full = [(i, t, lang, s, len(t or ""), 7, "h", 0.5, 3, 1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
