import pytest


@pytest.fixture
def frame(spark):
    """A small table of documents; extra columns carry names that operators use."""
    def make(rows, schema="doc_id long, text string, source string"):
        return spark.createDataFrame(rows, schema).selectExpr(
            "*", "1 as id", "2 as score", "3 as row", "'x' as digest", "4 as n", "true as kept", "5 as size", "6 as key")
    return make
