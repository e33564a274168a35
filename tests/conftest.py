import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def demand(spark):
    """Two years of five days for one series; the second year is far off the first one's range."""
    from tidecast.operators.contract import DEMAND_SCHEMA

    return spark.createDataFrame(demand_rows(), DEMAND_SCHEMA)


def demand_rows():
    from datetime import date

    rows = []
    for i in range(5):
        rows.append((date(2016, 3, 1 + i), "water", 1.0 + i, 10.0 + i, 15.0 + i, 5.0 + i, 50.0 + i, float(i)))
    for i in range(5):
        rows.append((date(2017, 3, 1 + i), "water", 100.0 + 10 * i, 110.0 + i, 15.0 + i, 5.0 + i, 50.0 + i, float(i)))
    return rows
