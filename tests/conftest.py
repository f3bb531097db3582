import pytest

from slowtruth.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Blocks of 8 rows, so that a few hundred rows cross many block borders."""
    from slowtruth.operators import scan

    monkeypatch.setattr(scan, "BLOCK_BITS", 3)
