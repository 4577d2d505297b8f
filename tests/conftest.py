import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siltstone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lake(tmp_path):
    from siltstone.operators.layers import Lake

    return Lake(str(tmp_path / "lake"))


def rows(df, *order):
    """Rows as tuples, sorted by all columns or in the frame's own order."""
    got = [tuple(r) for r in df.collect()]
    return got if order else sorted(got, key=repr)
