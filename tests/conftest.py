import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]
sys.path[:0] = HERE
os.environ["PYTHONPATH"] = os.pathsep.join([*HERE, os.environ.get("PYTHONPATH", "")])  # workers read the stubs of the tests there


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
