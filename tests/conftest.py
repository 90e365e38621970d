import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from geoloom.session import local_session

    return local_session(cores=4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
