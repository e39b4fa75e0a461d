import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", 4)
    ship(s)
    yield s
    s.stop()
