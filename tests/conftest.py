import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from hirelake.session import get_session

    s = get_session("tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("OFF")
    return s
