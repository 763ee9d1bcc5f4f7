import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from kredo.session import build_session, checkpoint_dir
    s = build_session("local[4]", app_name="kredo-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    """Collect as a list of dicts ordered by the given columns."""
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in cols)) if cols else out
