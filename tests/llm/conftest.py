import pytest


def texts_frame(spark, rows):
    """doc_id, text and columns whose names might clash with an operator's own."""
    rows = [(i, t, "en", "src0", 7, "x", "y") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, kept string, node string")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats, a very long text, ties, clashing columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "two words"), (5, long), (6, "É漢字 🙂 x\u0301"), (7, "!!! ???"), (8, "a  b\tc"), (9, "abc")]
    return rows, texts_frame(spark, rows), texts_frame(spark, [])
