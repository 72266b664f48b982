import pytest

from quoin.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
