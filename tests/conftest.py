import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from canvass.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", shuffle_partitions=8, app="canvass-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples of the given columns (all if none)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
