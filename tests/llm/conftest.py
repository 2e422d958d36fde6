import pytest

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    prose = "the house of the river stands near an old bridge and the people walk over it every day in the morning light"
    rows = [
        (1, prose, "en", "a", 1, "x"),
        (2, prose, "en", "a", 1, None),
        (3, None, None, None, None, None),
        (4, "", "en", "b", 0, "x"),
        (5, " \t\n ", "en", None, 4, "x"),
        (6, LONG, "en", "a", 1, "x"),
        (7, "one", None, "c", 3, "x"),
        (7, "one", None, "c", 3, "x"),
        (None, "a text without an id <|endoftext|> and  two spaces ", "fr", "b", 1, "x"),
        (9, "日本語 текст ελληνικά 12345 !!! é́   x\u0085y \x1c z", "xx", "b", 1, "x"),
        (10, (prose + " ") * 40, "en", "a", 1, "x"),
        (11, "trailing space \n \n x", "en", "b", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string").selectExpr("*", "1 as size", "2 as rank", "3 as n", "4 as _text", "5 as copies", "6 as `a b`", "7 as `x.y`", "8 as `q``z`")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def tiny(spark, sf):
    """Two hundred documents; small enough for brute force."""
    return spark.read.parquet(f"{sf}/documents.parquet")
