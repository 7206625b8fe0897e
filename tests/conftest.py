import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


TREE = "tree string, id bigint, parent_id bigint, px double, py double, pz double, dx double, dy double, dz double, radius_mm double"


@pytest.fixture(scope="session")
def make(spark):
    from pyspark.sql import functions as F

    def build(rows, tree="T"):
        df = spark.createDataFrame([(tree, *r) for r in rows], TREE)
        return df.withColumn("length_mm", F.sqrt((F.col("dx") - F.col("px")) ** 2 + (F.col("dy") - F.col("py")) ** 2 + (F.col("dz") - F.col("pz")) ** 2))

    return build


@pytest.fixture(scope="session")
def chain(make):
    return make([
        (1, -1, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.1), (2, 1, 5.0, 0.0, 0.0, 10.0, 3.0, 0.0, 0.05), (3, 1, 5.0, 0.0, 0.0, 10.0, -3.0, 0.0, 0.02),
        (4, 2, 10.0, 3.0, 0.0, 15.0, 5.0, 0.0, 0.01), (5, 2, 10.0, 3.0, 0.0, 15.0, 1.0, 0.0, 0.01)])
