import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the moon", "en", "a"),
        (1, "the cat sat on the mat and looked at the moon", "en", "a"),
        (2, "the cat sat on the mat and looked at the moon", None, "a"),
        (3, None, "en", None),
        (4, "", "fr", "b"),
        (5, " \t\n ", "fr", "b"),
        (6, "un chat est sur la table et regarde la lune " * 4000, "fr", "b"),
        (7, "one", "en", "a"),
        (None, "no id here but four words", "en", "a"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars", "1 AS fp", "2 AS size", "'x' AS rank_in_key", "3 AS root")
