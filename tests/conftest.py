import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from homestream.session import local_session
    return local_session(cpus=min(8, os.cpu_count() or 4), shuffle_partitions=4,
                         shared=str(tmp_path_factory.mktemp("shared")))
