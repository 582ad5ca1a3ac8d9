import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from colonnade.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def medium() -> str:
    return str(DATA / "sf0.01")


def rows(df, *names):
    """Rows as sorted tuples of the named columns."""
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
