import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    out = local_session(4, 8, "4g")
    out.sparkContext.setLogLevel("ERROR")
    return out
