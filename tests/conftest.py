import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[4]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tallyspark.session import checkpoint_dir
    checkpoint_dir(spark)
    yield spark


def d(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def prices_df(spark, rows, key="s"):
    """rows: [(iso timestamp, price or None)] for one series."""
    from tallyspark.sources.prices import PRICE_SCHEMA
    return spark.createDataFrame([(key, d(t), p) for t, p in rows], PRICE_SCHEMA)


def cpi_df(spark, rows):
    from tallyspark.sources.prices import CPI_SCHEMA
    return spark.createDataFrame([(dt.date.fromisoformat(p), v) for p, v in rows], CPI_SCHEMA)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tallyspark-test-")
