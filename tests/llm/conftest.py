import pytest

EDGE_TEXTS = [
    None,
    "",
    " \t\n ",
    "...",
    "word",
    "two words",
    "Ärger über Öl, und ßtraße  – naïve",
    "the cat sat on the mat and the dog sat on the log near the old mill",
    "the cat sat on the mat and the dog sat on the log near the old mill",
    "x" * 50_000,
    "long text of many words " * 5_000,
    "a b　c  d\r\ne\n\nf",
    "it's we're 3.5 a.b,c ... ,, <|endoftext|> \U0001f600 é .́",
]


@pytest.fixture
def edge_docs(spark):
    """Odd texts under NULL, repeated and plain ids, with an extra column and a repeated row."""
    rows = [(k if k else None, text, "en" if k % 2 else None, "s", 0) for k, text in enumerate(EDGE_TEXTS)]
    rows += [rows[7], rows[7], (5, "another text with the id of a text above", "de", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ha int")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)
