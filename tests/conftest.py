import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracklane.session import local_session

    session = local_session(8, "tracklane-tests")
    yield session
    session.stop()
