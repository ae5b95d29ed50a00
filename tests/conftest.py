import pytest

from commercelake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "commercelake-tests")
    yield session
    session.stop()
