import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from landroll.session import build_session  # noqa: E402

TEST_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "landroll-tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(TEST_DIR).exists():
        pytest.skip("test tables are not here")
    return TEST_DIR


def rows(df, *order):
    """Rows as tuples, sorted by the given columns when there are any."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
