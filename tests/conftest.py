import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)


@pytest.fixture(scope="session")
def spark():
    from spanveil.session import local

    session = local(4, "4g", 4)
    yield session
    session.stop()
