import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from brindle.session import local_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()


def rows(df):
    """Rows as sorted tuples, None first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])
