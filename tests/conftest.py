import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from listenflow import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="listenflow-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lf-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lf-test-wh-")})
    yield s
    s.stop()
