import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from texts or (id, text, lang, source) rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            r = (*r, *[None] * (4 - len(r)))
            full.append((*r, None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def scratch(spark):
    from permuta.llm._store import Scratch

    return Scratch(spark, "test")
