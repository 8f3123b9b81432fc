from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=4, app="cartwise-tests")


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one column on one row."""

    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
