"""Tables dealt out by their rows: the same rows, and steps that stay where
their rows are."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cartwise import common
from cartwise.operators import baskets as B
from cartwise.operators import catalog as C
from cartwise.operators import merges as M
from cartwise.operators import prices as P
from cartwise.operators import recipes as R
from cartwise.sources.adapters import Tables

LINE = "l_orderkey long, l_partkey long, l_quantity double"
ORDER = "o_orderkey long, o_custkey long"


@pytest.fixture()
def tables(spark, tmp_path):
    lines = [(o, p, float(q)) for o in range(40) for p, q in ((o % 7, 2), (o % 5, 3), (o % 7, 1))] + [(None, 1, 1.0), (3, None, 4.0), (3, 1, None), (99, 1, 1.0)]
    orders = [(o, o % 6) for o in range(40)] + [(3, 3), (4, 5), (None, 1)]
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(orders, ORDER).write.parquet(str(tmp_path / "orders.parquet"))
    return Tables(spark, str(tmp_path))


def test_baskets_are_the_rows_of_the_view(tables):
    assert rows(tables.baskets) == rows(tables.sql("SELECT * FROM baskets"))


def test_lines_meet_their_keys_before_they_are_dealt_out(spark, tables):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (3, 3), (4, 3), (None, 5)], "group_id long, product_id long")
    got = B.keyed_lines(tables.keyed_baskets(B.offer_keys(members)))
    key = F.coalesce("group_id", -F.col("product_id") - 1).alias("offer_key")
    want = tables.baskets.join(members, "product_id", "left").select("basket_id", "user_id", "product_id", key, "quantity")
    assert rows(got) == rows(want)


def test_tasks_grow_with_the_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 10)
    assert common.dealt(spark.range(1), 1000, "id").rdd.getNumPartitions() == 100
    assert rows(tables.baskets) == rows(tables.sql("SELECT * FROM baskets"))


def test_a_compare_is_dealt_out_once(spark):
    results = spark.createDataFrame(
        [(1, "A ", 5, 1, 1, 10, 2), (1, "a", 4, 1, 1, 11, 1), (1, "b", 9, 1, 1, 12, 3), (2, "a", 4, 1, 1, 10, 1), (3, "a", 7, 2, 2, 1, 1), (3, "b", 7, 2, 2, 2, 1), (3, "c", None, 1, 2, 3, 1)],
        "basket_id long, chain string, total_price long, lines_found long, required_lines long, store_id long, stores_priced long",
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        summary = B.compare_summary(results)
        assert summary._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = rows(summary.select("basket_id", "chains", "cheapest_chain", "cheapest_total", "stores_compared"))
    assert got == [(1, 2, "a", 4, 6), (3, 2, "a", 7, 3)]


def test_sliced_offers_are_the_cheapest_of_each_group(spark):
    offers = spark.createDataFrame([(1, 7, 5), (2, 7, 3), (3, 7, 9), (2, 8, None), (4, 8, 2)], "product_id long, store_id long, price long")
    members = spark.createDataFrame([(1, 1), (1, 2)], "group_id long, product_id long")
    sliced = B.group_offers(offers, members, False, 16)
    assert rows(sliced.select("offer_key", "store_id", "price")) == rows(B.group_offers(offers, members, False).select("offer_key", "store_id", "price"))


def test_latest_offers_are_those_of_the_latest_prices(spark):
    prices = spark.createDataFrame(
        [(1, 1, 9, 0, None, "2024-01-01", "b"), (1, 1, 8, 7, None, "2024-01-01", "a"), (1, 2, 5, None, None, None, "c"), (1, 2, 6, 0, "2024-01-02", None, "d"), (2, 1, None, 0, None, None, "e")],
        "product_id long, store_id long, price long, promo_price long, collected_at string, seen_at string, price_id string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("collected_at", "seen_at")})
    assert rows(P.latest_offers(prices, "price_id")) == rows(P.source_offers(P.latest_prices(prices, "price_id")))


def test_recipes_make_no_lines_for_what_a_chain_lacks(spark):
    items = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (1, None), (2, "z"), (None, "x"), (3, "y"), (3, "z")], "recipe_id long, ingredient string")
    per = spark.createDataFrame([("x", "a", 5), ("y", "a", None), ("y", "b", 3), ("x", None, 4), ("q", "a", 1)], "ingredient string, chain string, price long")
    done = R.price_recipes(items, per)
    assert rows(done.select("recipe_id", "chain", "covered", "total", "total_price", F.array_join("not_found", ",").alias("lacks"))) == [
        (1, "a", 1, 3, 5, "y"), (1, "b", 1, 3, 3, "x"), (3, "a", 0, 2, None, "y,z"), (3, "b", 1, 2, 3, "z"),
    ]


def test_counters_and_totals_are_alike_however_they_are_dealt(spark):
    have = spark.createDataFrame([(1, 1, 4, 9), (2, 1, None, None)], "user_id long, product_id long, count long, last_used long")
    picks = spark.createDataFrame([(1, 1, 12), (1, 1, 3), (3, 2, None), (None, 2, 1)], "user_id long, product_id long, at long")
    want = sorted([(1, 1, 6, 12), (2, 1, None, None), (3, 2, 1, None), (None, 2, 1, 1)], key=repr)
    for known in (0, 10_000_000):
        assert rows(M.bump_selections(have, picks, known)) == want
    members = spark.createDataFrame([(7, 1), (7, 2)], "group_id long, product_id long")
    chosen = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 5, 1)], "user_id long, product_id long, count long")
    for known in (0, 10_000_000):
        assert rows(C.selection_totals(chosen, members, known)) == [(1, "7", 5), (1, "u_5", 1)]
