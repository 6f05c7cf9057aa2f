import pytest

#: Odd rows: nulls, empty and blank texts, repeats, ties, one very long word, one long text.
ODD = [
    (None, "some words without an id that go on for a while in this text of thirteen words or more", "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", None),
    (4, "one", None, "b"),
    (5, "x" * 50_000, "en", "a"),
    (6, "word " * 20_000, "en", "a"),
    (7, "the same text stands here twice and it is long enough to hold one window of words", "en", "a"),
    (8, "the same text stands here twice and it is long enough to hold one window of words", "en", "a"),
    (8, "the same text stands here twice and it is long enough to hold one window of words", "en", "a"),
    (9, "ä ö ü 日本語   \x85 \x00 🙂", "de", "a"),
    (10, "!!! ??? ...", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns of names that operators could use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("words", "w", "score", "keys", "h", "hits", "id", "class_id", "n", "label", "item_id", "found"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench_items(spark):
    return spark.createDataFrame([(1, "the same text stands here twice and it is"), (2, None), (3, ""), (4, "one"), (None, "words")], "item_id bigint, text string")
