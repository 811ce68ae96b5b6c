import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from weft.session import build_session, share_package

    session = build_session("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    share_package(session)
    return session
