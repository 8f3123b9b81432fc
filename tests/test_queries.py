"""Registered queries against their SQL on the smallest tables.

A spread of queries runs by default; CARTWISE_ALL=1 runs every one.
"""

from __future__ import annotations

import math
import os
from decimal import Decimal

import pytest

duckdb = pytest.importorskip("duckdb")

import cartwise.plans  # noqa: E402, F401
from cartwise.plans.registry import ORACLES, QUERIES  # noqa: E402
from cartwise.sources.adapters import RAW  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ("cheapest_store_for_every_basket", "ag02_latest_prices_fallback", "ag08_basket_compare_summary", "ag16_event_totals", "ag27_price_sensitivity", "sb13_substitution_decisions", "jn09_match_preview", "me07_mirror_prices", "sf08_parse_quantity", "ss02_price_feed")
NAMES = sorted(ORACLES) if os.environ.get("CARTWISE_ALL") else [n for n in SAMPLE if n in ORACLES]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    connection = duckdb.connect()
    for name in RAW:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return f"{value:.9g}" if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 10**8 else str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    expected = cursor.fetchall()
    assert got == table([d[0] for d in cursor.description], expected)


def test_every_query_is_named_once():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 200
