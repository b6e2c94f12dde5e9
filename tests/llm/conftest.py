import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame in several partitions."""
    def make(rows, schema, parts=3):
        return spark.createDataFrame(list(rows), schema).repartition(parts)
    return make
