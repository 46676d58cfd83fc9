import pytest

from seqloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()
