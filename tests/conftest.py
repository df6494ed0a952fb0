import pytest

from ledgerloom.session import local


@pytest.fixture(scope="session")
def spark():
    session = local(4, 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
