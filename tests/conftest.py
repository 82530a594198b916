import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from verisift.session import get_spark

    session = get_spark("tests", cores="4", shuffle=4)
    yield session
    session.stop()
