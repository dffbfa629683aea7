import pytest

from conceptlake.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session()
