import pytest

#: doc_id, text: nulls, empties, repeats, ties and a long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again until it rests."),
    (2, "The quick brown fox jumps over the lazy dog again and again until it rests."),
    (2, "The quick brown fox jumps over the lazy dog again and again until it rests."),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (None, "no id here, only words"),
    (None, "no id here, only words"),
    (6, "long " * 5000 + "end"),
    (7, "Ünïcödé — ß ﬁ 漢字 \U0001f600 mixed spaces"),
    (8, "a"),
    (9, "a b"),
]


@pytest.fixture
def odd(spark):
    """A documents table with odd rows and columns whose names the operators use
    themselves."""
    rows = [(i, t, "en", None if k % 4 == 0 else f"src{k % 3}", 0, "x", 1, "y", 2) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, blob string, size long, fp string, row long")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
