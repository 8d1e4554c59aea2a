import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tracewise.session import build_session  # noqa: E402
from tracewise.sources.seed import seed_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="tracewise-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    return seed_tables(spark)


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all when none)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
