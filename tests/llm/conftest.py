import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source)."""

    def make(*rows, schema=DOCS):
        full = [(k, r, "en", "s", len(r or "")) if r is None or isinstance(r, str) else (*r, len(r[1] or "")) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, schema)

    return make
