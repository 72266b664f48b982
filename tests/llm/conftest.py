import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (id, text) pairs, with columns whose names clash with those of the operators."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, ids string, _copy string, line int"

    def make(pairs, lang=None):
        return spark.createDataFrame([(k, t, (lang or {}).get(k), "src", None if t is None else len(t), "x", "y", "z", 1) for k, t in pairs], schema)

    return make
