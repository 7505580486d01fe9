"""One small session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def many_ranges(spark):
    """More ranges than a sample settles, put together by their bytes, as in large tables: two readers of one plan get unlike ones."""
    ours = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "24"}
    had = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)
