import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls, blanks, ties, repeated rows, a very long text and extra columns with the operators' own names."""
    rows = [
        (1, "the cat sat on the mat and the dog ran", "en", "a", 9),
        (1, "the cat sat on the mat and the dog ran", "en", "a", 9),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", None, 0),
        (None, "no id here at all but words", "en", "b", 1),
        (6, "one", "en", "b", 1),
        (7, "word " * 60_000, "en", "b", 1),
        (8, "Ünïcode 日本語 ЖЖ ß", "xx", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "toxic", "cls", "copy", "start", "n", "key", "chunk", "bucket", "spans"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
