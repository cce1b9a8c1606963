import pytest

from strataform.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "3g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
