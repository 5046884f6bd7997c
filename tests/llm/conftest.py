import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, cls long"


@pytest.fixture
def documents(spark):
    """Documents with extra columns whose names the operators use themselves."""
    def make(rows, slices=3):
        full = [(i, t, lang, "s", None if t is None else len(t), "x", 1) for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS).repartition(slices)

    return make
