import pytest

LONG = "alpha beta gamma delta epsilon zeta " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names
    operators use themselves."""
    rows = [
        (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, "   \n\t "),
        (5, LONG), (None, "ONE two three four five six"), (None, None), (6, "x"), (7, "çà № 東京 😀 mail a.b@c.de"),
        (8, "one two three four five six"), (2, "Другой текст"),
    ]
    full = [(i, t, None if i == 3 else "en", None if i == 4 else "s1", 0, "clash", 1.5, [1], True) for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, sketch string, score double, p array<int>, kept boolean"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
