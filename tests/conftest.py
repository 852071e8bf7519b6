from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronoweave.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session("8", app="tests", memory="4g"))
    yield session
    session.stop()
