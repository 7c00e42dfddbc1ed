import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from gaugeline.session import local_session, remove_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("gaugeline-tests", cores="4", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
