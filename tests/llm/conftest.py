"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, empty, blank and long texts, repeats of rows, texts and identifiers."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
    rows = [
        (1, "a b c", "en", "s1", 5),
        (2, "a b c", "en", "s1", 5),
        (2, "a b c", "en", "s1", 5),
        (3, None, "en", "s2", None),
        (4, "", None, None, 0),
        (5, " \t\n", "de", None, 3),
        (None, "a b c", "en", "s1", 5),
        (None, None, None, None, None),
        (6, f"start {passage} end", "en", "s3", 1),
        (7, f"other {passage} tail of it", "en", "s3", 1),
        (7, f"other {passage} tail of it, changed", "en", "s3", 1),
        (8, long, "fr", "s2", len(long)),
        (9, long + " more", "fr", "s2", len(long)),
        (10, "é ß 漢字 🙂 á", "xx", "s1", 12),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = "id digest keep_id n row key size target epochs fp root component_id node hash start end kind score text_sha256 own stay span lo hi words features kept".split()
    return odd.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names)])
