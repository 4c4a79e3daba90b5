import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lakescope.session import local_session

    s = local_session("*", 8, app="lakescope-tests")
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=_key)


def _key(t):
    return tuple((x is None, "" if x is None else x) if not isinstance(x, (int, float)) else (False, x) for x in t)
