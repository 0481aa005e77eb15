from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import build_session, ship

    session = build_session("tests", cores="4", shuffle_partitions=4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Table from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows_of(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
