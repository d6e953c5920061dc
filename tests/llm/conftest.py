import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens int, kept string, component_id string, spans string, items int, runs int, shingles string, n_words string"


def rows(texts, start=0):
    return [(i, t, "en", "s", len(t or ""), None, None, None, None, None, None, None, None, None) for i, t in enumerate(texts, start)]


@pytest.fixture
def frame(spark):
    """Documents with columns whose names clash with the operators' own."""
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, a repeated row, a very long word and a very long text."""
    texts = ["", " \n\t", "one", None, "two words", "x" * 30_000, "long text here. " * 4_000, "éü 中文 😀 \x00 \x7f", "a a a a a a a a a a a a"]
    data = rows(texts)
    return spark.createDataFrame([*data, data[4], (None,) * 14, (None, "no id here at all", *[None] * 12)], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
