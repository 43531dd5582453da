import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id string, h long, s int, e int, key string, size int, digest string, _clean string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang); the other columns have names that operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), 0.5, "c", 1, 2, 3, "k", 4, "d", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    """Real-looking documents: those of the smallest tables."""
    from tests.conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
