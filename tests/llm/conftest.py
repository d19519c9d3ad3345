import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, n string, key string, token string, g string, teaches string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text[, lang]) tuples, with further columns whose names the operators use inside."""

    def make(rows):
        data = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), 7, "n", "k", "t", "g", "x") for r in rows]
        return spark.createDataFrame(data, DOCS)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


#: Nulls, empty and blank texts, repeated rows, ties, no words, long runs without a break.
ODD = [
    (None, "a text without an id"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "!!! ... ---"),
    (5, "One. Two. Three. Four. Five."),
    (5, "One. Two. Three. Four. Five."),
    (6, "x" * 70000),
    (7, "the same words stand in this text as in the next one of the table, all of them, to the end. And one more sentence follows it here."),
    (8, "the same words stand in this text as in the next one of the table, all of them, to the end. And one more sentence follows it here."),
    (9, "Das Das Das " * 40),
    (10, "é" * 120 + " ß日本 " * 30),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def odd_rows():
    """(id, text) of the odd rows that take part."""
    return [(i, t) for i, t in ODD if i is not None]
