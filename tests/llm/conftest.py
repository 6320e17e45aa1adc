import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) rows, with columns whose names operators use inside as well."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, "x", 7) for r in rows]
        return spark.createDataFrame(full, DOCS + ", word string, bits int").repartition(2)

    return make


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "one two"), (None, None), (6, LONG), (7, LONG + " end"),
        (8, "\x00 control \x1f é日本 🙂"),
    ]
