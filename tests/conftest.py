import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

from polyphony.session import get_spark  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cpus=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def has_data(sf: str = "sf0.001") -> bool:
    return (DATA / sf).is_dir()
