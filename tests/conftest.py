import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from florascope.session import get_spark

    s = get_spark(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
