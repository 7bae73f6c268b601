import pytest

from panelloom.llm.common import importable

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, start string, path string, kind int"


@pytest.fixture(scope="session")
def sp(spark):
    return importable(spark)


@pytest.fixture
def documents(sp):
    """Rows of ``(doc_id, text, lang, source)`` as documents with extra columns of clashing names."""

    def build(rows):
        full = [(*r, len(r[1]) if r[1] is not None else None, "s", None, 1) for r in rows]
        return sp.createDataFrame(full, DOCS)

    return build


#: Nulls, empty, blank, repeated and long texts, equal ids.
EDGES = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \t\n ", "en", None),
    (4, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (4, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (5, "One two three four five six seven eight nine ten eleven", None, None),
    (6, "ab " * 30_000, "en", "b"),
    (7, "x" * 50_000, "en", "b"),
    (None, "é 日本 😀 a.b@c.de 1.2.3.4", "de", "a"),
]
