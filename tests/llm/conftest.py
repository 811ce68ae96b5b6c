import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, row string, doc string, gone long, judged string, n_lines string"


def rows_of(texts, start=0, lang="en"):
    return [(start + i, t, lang, "src", len(t) if t is not None else None, "x", None, "y", 1, "z", "q") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of texts, with extra columns whose names clash with working names."""
    return lambda texts, **kw: spark.createDataFrame(rows_of(texts, **kw), SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and blank texts, a very long one, ties and repeated rows."""
    long = "the quick brown fox jumps over a lazy dog and runs " * 20_000
    rows = rows_of([None, "", " \n\t ", "one", "same text of five words here", "same text of five words here", long, "x" * 300_000, "Ünï çödé 漢字 😀 \u0000 end"])
    rows += [rows[4], rows[4]]
    rows += [(None, "no id at all but some words", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
