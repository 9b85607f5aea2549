import pytest

SF = "/root/testdata/sf0.001"
LONG = "Wort und noch ein Wort\n" * 20_000


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeats, clashing names."""
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t \r\n", "en", "a"),
        (4, "12 34 !! ??", "de", "b"),
        (5, LONG, "de", None),
        (6, "the cat sat on the mat and the dog sat on the log", "en", "b"),
        (7, "the cat sat on the mat and the dog sat on the log", "en", "b"),
        (7, "the cat sat on the mat and the dog sat on the log", "en", "b"),
        (8, "eins", None, "c"),
        (9, "Ünïcode 漢字 \U0001f600 text\x0bwith\x0codd\x1cblanks", "en", "c"),
        (None, "no id here but a text", "en", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    clashing = ["key", "label", "n", "size", "rank", "a", "b", "component", "words", "ids", "copies", "target"]
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *(f"'x' AS {c}" for c in clashing))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
