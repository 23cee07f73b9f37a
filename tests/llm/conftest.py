"""Documents with the awkward cases that every operator must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _folio_row_at string, recipe string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeats, ties, extra columns with clashing names."""
    long = " ".join(f"word{i % 977} thing" for i in range(60_000))
    texts = [None, "", " \t\n", "one", "two words", "The cat sat on the mat. The dog sat on the log.", "the cat  sat on the mat. The dog\tsat on the log.", long, long, "漢字かな交じり文。", "a\x00b \x1c c", "😀 émoji ﬁ"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "web", 0, "x", "y") for i, t in enumerate(texts)]
    rows += [(5, texts[5], None, None, None, None, None), (None, "no id at all here", None, None, None, None, None), (None, None, None, None, None, None, None), (99, "one", "en", "web", 3, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
