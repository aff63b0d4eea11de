import pytest

from commerce_marts.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
