import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("hushtext-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def run(spark):
    """Redact a list of texts; returns rows in the same order."""
    from hushtext import redact

    def go(texts, **options):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        rows = redact(df, **options).collect()
        return sorted(rows, key=lambda row: row.id)

    return go


def counted(row):
    """The counters that are not zero."""
    return {k: n for k, n in row.redaction_counts.asDict().items() if n}
