import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from limnos.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="limnos-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples."""
    out = [tuple(r[c] for c in cols) for r in df.collect()]

    def k(x):
        if x is None:
            return (1, 0)
        return (0, x if isinstance(x, (int, float, str, bytes)) or hasattr(x, "isoformat") else str(x))
    return sorted(out, key=lambda t: tuple(k(x) for x in t))
