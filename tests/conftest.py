import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewall.session import local_session

    folder = str(tmp_path_factory.mktemp("checkpoint"))
    s = local_session(8, "tests", spark__checkpoint__dir=folder, spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
