import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))


@pytest.fixture(scope="session")
def spark():
    from matchloom.session import get_spark

    s = get_spark("tests", cpus=8, shuffle=8)
    yield s
    s.stop()
