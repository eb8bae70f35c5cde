import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from newsatlas.session import prepare

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over a one-row table: one(expression, name=value, ...)."""

    def value(expression, **cells):
        schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items())
        return spark.createDataFrame([tuple(cells.values())], schema).select(expression.alias("x")).first()["x"]

    return value
