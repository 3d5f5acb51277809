import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from codicil.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression over one text."""
    from pyspark.sql import functions as F

    def run(expression, **columns):
        row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
        return row.select(expression.alias("x")).first()["x"]

    run.col = F.col
    return run
