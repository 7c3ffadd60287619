import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paths import SF001  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from flowbin.session import ensure_checkpoint_dir, local_session

    s = local_session("tests", partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="flowbin-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def flow001(spark):
    from flowbin.plans.queries import flow

    return flow(spark, SF001)
