import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluates a column function on literals."""
    from pyspark.sql import functions as F

    def run(f, *args, schema=None):
        if schema:
            return spark.createDataFrame([args], schema).select(f(*[F.col(c.split()[0]) for c in schema.split(", ")]).alias("v")).first().v
        return spark.range(1).select(f(*[F.lit(a) for a in args]).alias("v")).first().v

    return run
