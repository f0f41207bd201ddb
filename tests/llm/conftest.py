import pytest

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, node long, bit string, part int, row string, held_out string, hi int, toxic string, label string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows, and one id with two texts."""
    prose = "the quick brown fox jumps over the lazy dog and then walks home along the river before it gets dark"
    return [
        (1, None, None), (2, "", "s1"), (3, " \t\n\x0b\x0c\r ", "s1"), (4, prose, "s1"), (4, prose, "s1"), (5, prose, None), (6, prose + " today", "s2"), (7, "Ünïcödé ñandú 漢字 <|endoftext|> é́ word's 12²", "s2"),
        (8, ("lorem ipsum dolor sit amet " * 40_000).strip(), "s2"), (9, "x", "s3"), (None, prose, "s3"), (None, "only here", "s3"), (10, "one text", "s3"), (10, "another text of the same id", "s3"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, t, None, s, None, 7, "k", 1, "b", 3, "r", "h", 2, "x", "l") for i, t, s in odd_rows]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
