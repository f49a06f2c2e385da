import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tremorlake.session import build_session

    s = build_session("local[*]", app="tremorlake-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-")})
    yield s
    s.stop()
