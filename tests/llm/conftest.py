import pytest


@pytest.fixture
def docs(spark):
    """Makes (doc_id, text) rows with further columns whose names operators use inside."""

    def make(rows, partitions=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, key long, signature string, value string, score string"
        full = [(i, t, "en", "src0", len(t or ""), 1, "s", "v", "x") for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
