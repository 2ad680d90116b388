import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from lexmill.session import local_session

    session = local_session("tests", cpus="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
