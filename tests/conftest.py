"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from relomap.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables are not here")
    return SMALL
