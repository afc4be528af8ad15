import pytest

LONG = "Lorem words of a very long text, and more. " * 5000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, a column whose name clashes with results."""
    rows = [
        (1, "One plain text of some words.", None, "s", 29, "x"),
        (1, "One plain text of some words.", "en", "s", 29, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, None, 0, "y"),
        (None, "A text without a number, kept as it is.", "en", "s", 39, "z"),
        (4, LONG, "en", "s", len(LONG), "z"),
        (5, " \n\t\r\x0b ", "en", "s", 6, "z"),
        (6, "x" * 30_000, "en", "s", 30_000, "z"),
        (7, "𝒳 émail é@x.y a@b.co \U0001f600 " * 3, "fr", "s", 60, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture()
def as_tables(tmp_path):
    """Writes DataFrames as the tables of a folder, and names it."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
