from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

import pytest

from tidegrid.session import local_session
from tidegrid.splits import ROWS_PER_TASK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def rows_per_task(spark):
    """A context in which a series of more than ``n`` rows counts as long."""

    @contextmanager
    def use(n: int):
        spark.conf.set(ROWS_PER_TASK, str(n))
        try:
            yield
        finally:
            spark.conf.unset(ROWS_PER_TASK)

    return use


@pytest.fixture
def series_of(spark):
    """Build series from ``{id: [(timestamp text, value), ...]}``."""

    def build(data: dict, schema: str = "item_id string, ts timestamp_ntz, y double"):
        rows = [(k, dt.datetime.fromisoformat(t) if t else None, None if v is None else float(v)) for k, points in data.items() for t, v in points]
        return spark.createDataFrame(rows, schema)

    return build


def days(values, start="2024-01-01"):
    first = dt.datetime.fromisoformat(start)
    return [((first + dt.timedelta(days=i)).isoformat(), v) for i, v in enumerate(values)]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def table(df, digits=6):
    """All rows in a comparable form, whatever their order."""
    cols = sorted(df.columns)

    def cell(v):
        return f"{v:.{digits}g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
