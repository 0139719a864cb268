import pytest

from tests.oracle import make_spark


@pytest.fixture(scope="session")
def spark():
    session = make_spark("4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
