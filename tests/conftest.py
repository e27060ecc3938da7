import pytest

from corpusmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "tests")


@pytest.fixture(scope="session")
def one(spark):
    """The value of an expression over one row."""

    def run(column, **values):
        row = spark.range(1)
        for name, value in values.items():
            from pyspark.sql import functions as F

            row = row.withColumn(name, F.lit(value))
        return row.select(column.alias("x")).first()["x"]

    return run
