import pytest

from siltstone.llm import registry


@pytest.fixture
def docs(spark):
    """Makes documents out of (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(pairs):
        rows = [(i, t, "en", "src", 1, 7, "x", 3) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, sig string, count bigint")

    return make


@pytest.fixture
def folder(spark, tmp_path, docs):
    """Writes tables to a data folder and returns its path."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


@pytest.fixture
def query():
    return lambda name: registry.QUERIES[name]
