import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from duolex.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("duolex-tests", os.environ.get("TEST_CPUS", "8"))
    yield session
    session.stop()
