import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # A zone with daylight saving: results must not depend on it.
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def clean_stage(spark, sf):
    from ebbline.catalog import stages

    return stages.cleaned(spark, sf)


def frame(spark, rows, schema):
    """Rows with ISO date strings for timestamp_ntz columns."""
    from pyspark.sql import functions as F

    parts = [p.strip().rsplit(" ", 1) for p in schema.split(",")]
    text = ", ".join(f"{n} {'string' if k == 'ts' else k}" for n, k in parts)
    df = spark.createDataFrame(rows, text)
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, k in parts if k == "ts"})


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
