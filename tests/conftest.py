import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from check import session

    s = session()
    yield s
    s.stop()


@pytest.fixture
def rows():
    return lambda df, *cols: sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())
