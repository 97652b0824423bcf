import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from waymark import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "local[8]", "waymark-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="waymark-tests-")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
