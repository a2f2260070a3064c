import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("the test tables are not here")
    return SMALL
