import os
import sys
from collections import Counter

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _active(spark):
    return spark


def bag(rows):
    """Rows as a multiset, floats rounded."""

    def cell(x):
        return round(x, 6) if isinstance(x, float) else x

    return Counter(tuple(sorted((k, cell(v)) for k, v in dict(r).items())) for r in rows)


@pytest.fixture
def same():
    def check(got, expected):
        assert bag(got) == bag(expected)

    return check
