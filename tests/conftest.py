import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tallyrisk.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(shuffle_partitions=4, spark__sql__adaptive__coalescePartitions__enabled="true")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF
