import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("spark")
    s = SparkSession.builder.master("local[8]").config(map={
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.sql.warehouse.dir": str(top / "warehouse"), "spark.checkpoint.dir": f"file://{top}/shared", "spark.local.dir": str(top / "local"),
    }).getOrCreate()
    yield s
    s.stop()
