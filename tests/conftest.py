import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from codeloom.session import local_session, ship  # noqa: E402

SMALL = "/root/testdata/sf0.001"
ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(4, 4, "tests"))
    session.sparkContext.setLogLevel("ERROR")
    return session
