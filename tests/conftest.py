import pytest

from tests import oracle


@pytest.fixture(scope="session")
def spark():
    return oracle.session()


@pytest.fixture(scope="session")
def con():
    return oracle.duck(SMALL)


SMALL = "/root/testdata/sf0.001"
