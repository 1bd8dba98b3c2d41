import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from lattica.session import local_session, ship

    session = local_session(4, partitions=4, memory="4g")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest tables."""
    return str(DATA / "sf0.001")
