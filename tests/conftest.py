import os
import sys

import pytest

HERE = os.path.dirname(__file__)
sys.path.insert(0, os.path.join(HERE, ".."))
sys.path.insert(0, HERE)

from newsiq import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return get_session("tests", os.environ.get("TEST_CPUS", "8"), spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
