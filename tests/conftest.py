import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wellspan.session import local_session

    os.environ.setdefault("WELLSPAN_SHUFFLE_PARTITIONS", "4")
    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
