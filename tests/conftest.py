import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="faultline-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def lines_df(spark):
    def make(rows):
        return spark.createDataFrame(list(enumerate(rows)), "line_id long, line string")
    return make
