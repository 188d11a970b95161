import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flagstone.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(cpus=4, shuffle_partitions=4, app="flagstone-tests")
    yield s


def rows(df, *cols):
    """Sorted list of tuples (of the given columns or all)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
