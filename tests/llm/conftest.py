import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty, ties, repeated rows, very long text, and extra columns with names that operators use themselves.
ODD = [
    (None, None, None, None, None),
    (None, "a null id", "en", None, 9),
    (1, "", "en", "s", 0),
    (2, None, "en", "s", None),
    (3, "the same words in the same order again and again " * 9, "en", "s", 10),
    (3, "the same words in the same order again and again " * 9, "en", "s", 10),
    (4, "the same words in the same order again and again " * 9, "en", "t", 10),
    (5, "x" * 300_000, "en", "s", 300_000),
    (6, "12345 !!! ???", None, "s", 13),
    (7, "  two  spaces\t\ttabs\n\nlines <|endoftext|> é中文 ", "fr", "s", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({n: F.lit("clash") for n in ("fp0", "key", "h", "_rank", "component_id", "start", "length", "row", "keep", "_n", "_kept", "_row", "node", "group", "band")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
