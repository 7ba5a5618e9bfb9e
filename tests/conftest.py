import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fenceline.session import get_spark
    s = get_spark("tests", master="local[4]", shuffle_partitions=4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.dataFrameQueryContext.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
