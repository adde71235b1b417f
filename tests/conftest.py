import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stellwerk.session import build_session

    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
