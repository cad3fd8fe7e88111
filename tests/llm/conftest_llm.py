import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, row int, list string, c int, node int, h int, sig int, copies int, number int, toxic string, quality string, key int, _id int, live int"
LONG = " ".join(f"word{i} and" for i in range(30_000))


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, "l", 2, 3, 4, 5, 6, 7, "t", "q", 8, 9, 10) for i, t, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and ids, no words, clashing names."""
    rows = [(1, "alpha beta gamma delta", "a"), (1, "alpha beta gamma delta", "a"), (2, None, "a"), (3, "", None), (None, "some text with a null id", "b"), (4, LONG, "b"), (5, "!!! ... ***", "c"), (6, "é😀 ünïcode\x00 tab\tline\nend", None), (7, " \n\t ", "c"), (1, "another text with id one", "d"), (None, None, None)]
    return docs_of(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
