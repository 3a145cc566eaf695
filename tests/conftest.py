import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from ripplework.session import build_session

    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
