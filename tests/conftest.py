import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from vertexloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
