import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rankfold.session import get_session

    s = get_session(8)
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df):
    """Rows with columns by name, numbers rounded, in any order."""
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    def cell(v):
        return v if v is None or isinstance(v, (str, bool)) else round(float(v), 6)

    return sorted(repr([cell(v) for v in r]) for r in df.values.tolist())
