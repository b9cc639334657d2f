import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    return make


@pytest.fixture(scope="session")
def lexicon(spark):
    def make(*entries):
        rows = [(i, t, c, list(a), n, k, "s") for i, (t, c, a, n, k) in enumerate(entries)]
        return spark.createDataFrame(
            rows, "ord int, term string, category string, alternatives array<string>, note string, condition string, source string"
        )

    return make
