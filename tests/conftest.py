import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strandlab.session import build_session

    session = build_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
