from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from glossa.session import get_session, ship

    session = get_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    ship(session)
    yield session
    session.stop()
