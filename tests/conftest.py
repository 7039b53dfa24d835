import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    yield s
    s.stop()
