import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from catalith.session import local_session

    return local_session(cpus=8, memory="4g")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
