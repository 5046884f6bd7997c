import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from glyphaudit.plans.session import tune

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return tune(s)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def buffers(spark):
    """A table (id, content) from a list of bytes."""
    def make(values, slices=3):
        rows = [(i, bytearray(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "id int, content binary").repartition(slices)

    return make
