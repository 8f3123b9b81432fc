"""Queries that give their operators each piece of work once."""

from __future__ import annotations

import datetime

import pytest
from conftest import rows

from cartwise.operators import baskets as B
from cartwise.operators import catalog as C
from cartwise.plans.registry import QUERIES

DAY = datetime.datetime(2001, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    parts = [(i, "red bolt" if i < 4 else "hot ring", f"Brand#{i % 2}", "LARGE", 1, 900.0) for i in range(6)]
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(i, f"s{i}", i % 2, 1.0) for i in range(1, 9)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "customer": ([(i, f"c{i}") for i in (0, 1, 2, 3, 3, 4, None)], "c_custkey long, c_name string"),
        "orders": ([(i, i % 3) for i in range(6)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i % 6, i % 4, i % 8 + 1, i, 2.0, 100.0 + i, 0.0, 0.0, "N", DAY) for i in range(24)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def test_equal_searches_are_asked_once(spark, folder, monkeypatch):
    asked, join = [], C.token_search_join
    monkeypatch.setattr(C, "token_search_join", lambda queries, grouped: asked.append(queries) or join(queries, grouped))
    got = rows(QUERIES["pf07_token_search_many"](spark, folder).select("query_id", "hits", "id_sum"))
    assert got == [(0, 4, 6), (1, 4, 6), (2, 4, 6), (3, 8, 12), (4, 2, 9)]  # the customer that comes twice counts twice
    assert rows(asked[0].select("q")) == [("bolt red",), ("ring hot",)]


def test_snapshot_winners_need_no_lists(spark, folder, monkeypatch):
    seen, saved = [], B.saved_winner
    monkeypatch.setattr(B, "saved_winner", lambda results, *more: seen.append(results.columns) or saved(results, *more))
    got = QUERIES["me16_basket_snapshots"](spark, folder).collect()
    assert "stores" not in seen[0]
    assert all(r["items"] > 0 and r["stores_listed"] > 0 for r in got)
