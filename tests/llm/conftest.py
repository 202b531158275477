import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, part int, label string, rid long, length int"
ODD = [
    (1, "Ann's cat  sat.\nIt was 12,3 é ́ x", "en", "a", 1, 1, "k", 1, "l", 1, 1),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 1, "k", 1, "l", 1, 1),
    (4, " \t\n ", "en", "a", 4, 1, "k", 1, "l", 1, 1),
    (5, "<|endoftext|> a <|startoftext|>b ▁ </s>", "en", "a", 1, 1, "k", 1, "l", 1, 1),
    (6, "the quick brown fox jumps over the lazy dog " * 2500, "en", "a", 1, 1, "k", 1, "l", 1, 1),
    (7, "same words here in both of these", "en", "a", 1, 1, "k", 1, "l", 1, 1),
    (8, "Same  words here\tin both of these", "en", "a", 1, 1, "k", 1, "l", 1, 1),
    (8, "Same  words here\tin both of these", "en", "a", 1, 1, "k", 1, "l", 1, 1),
    (9, "x" * 5000, "en", "a", 1, 1, "k", 1, "l", 1, 1),
    (None, "no id 日本 😀", "en", "a", 1, 1, "k", 1, "l", 1, 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path
