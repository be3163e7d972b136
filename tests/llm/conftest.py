import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven old sailors sing a slow song about the sea. "
ROWS = [
    (1, PROSE * 3, "en", "a", 10),
    (1, PROSE * 3, "en", "a", 10),  # the same row again
    (1, "Ein anderer Text unter der gleichen Nummer, mit Umlauten: äöü.", "de", "a", 1),  # only the id again
    (2, PROSE * 3 + "Extra words at the end here.", "en", None, None),
    (3, None, "en", "b", 0),
    (4, "", None, "b", 0),
    (5, " \n\t ", "fr", None, 4),
    (6, "12345 !!! 67.8", None, "c", 14),
    (None, PROSE + "Nobody knows the number of this page.", "en", "c", 5),
    (7, "x" * 30_000, "en", "d", 30_000),
    (8, PROSE * 400, "en", "d", 0),
    (9, "Größe Straße über schön 日本語 👩‍👩‍👧 naïve", "de", "e", 3),
    (10, "two words", "en", "e", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long, repeated and shared-id rows."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns named like the ones the operators use or add."""
    names = (
        "lang_pred", "score", "fp", "root", "component_id", "leaks", "base", "added", "spans", "kept", "n_bytes", "n_tokens", "ids",
        "decoded", "decoded_bytes", "packed_ids", "n_sentences", "n_removed", "p_toxic", "p_quality", "toxic", "start", "end", "anchor", "a", "b",
        "item_id", "first", "term", "entity", "ids_sha256", "weird name.x",
    )
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
