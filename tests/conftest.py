import pytest

from cellweave.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
