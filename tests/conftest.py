import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from regrove.session import local_session
    s = local_session(8, 8, "regrove-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
