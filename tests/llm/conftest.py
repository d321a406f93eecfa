import pytest

LONG = " ".join(f"w{i % 977}x" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It was a fine day.", "a", 0, "x"), (2, None, None, None, None), (3, "", "b", 1, ""), (None, "no id here", "a", 1, "y"), (None, None, None, None, None),
        (1, "The quick brown fox jumps over the lazy dog. It was a fine day.", "a", 0, "x"), (4, LONG, "b", 2, "z"), (5, " \n\t ", "a", 3, "x"), (6, "naïve café ﬁ 日本語  two  spaces\n\nlines <|endoftext|>", "c", 4, "x"), (7, "The quick brown fox jumps over the lazy dog. It was a fine day.", "a", 0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int, ledger string").withColumnsRenamed({"ledger": "#ledger"}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
