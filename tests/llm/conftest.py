import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"wort{i % 977} und" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat.", "en", "a", 1),
        (2, "The  cat sat on\nthe mat.", "en", "b", None),
        (3, None, None, None, None),
        (4, "", "en", "a", 2),
        (5, " \t\r\n\x0b\x0c", "de", None, 3),
        (6, long, "de", "b", 4),
        (7, "12345 67890 !!", "en", "a", 5),
        (None, "no id here", "en", "c", 6),
        (None, "no id here", "en", "c", 6),
        (8, "twice", None, "a", 7),
        (8, "twice", None, "a", 7),
        (9, "Ünïcödé 𝄞 text ﬀ", "de", "c", 8),
        (10, "Ünïcödé 𝄞 text ﬀ", "de", "c", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "lang_pred", "fp", "kept", "__norm", "__key", "__mark", "id"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
