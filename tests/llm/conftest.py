import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _d string, node string, key string, size string, row string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text, source) rows, with more columns whose names clash with operators' own."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t is not None else None, "x", "x", "x", "x", "x") for i, t, s in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [
        (1, None, "a"), (2, "", None), (3, "   \n\t ", "a"), (4, "one two", "b"), (4, "one two", "b"), (None, "one two", "b"), (None, None, None), (5, long, "b"), (6, long, "c"), (7, "x" * 100_000, "c"), (8, "Ünï cödé ☃ 漢字 \U0001f600   end", "c"),
    ]
