import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pointbook.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="pointbook-tests", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols, order=None):
    """Collect ``cols`` of ``df`` as tuples, sorted for stable comparison."""
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=lambda t: tuple("" if v is None else str(v) for v in t)) if order is None else out
