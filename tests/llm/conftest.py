import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source) rows, in a few partitions."""

    def make(rows):
        full = [(*r, *(("en", "s")[len(r) - 2:] if len(r) < 4 else ()), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.repartition(3) if full else df

    return make
