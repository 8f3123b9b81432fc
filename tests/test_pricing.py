"""Prices, stores and baskets."""

from __future__ import annotations

import random
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from cartwise.common import positions
from cartwise.operators import baskets as B
from cartwise.operators import prices as P
from cartwise.operators import recipes as R
from cartwise.operators import stores as S

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
PRICES = "product_id long, store_id long, price long, promo_price long, collected_at timestamp, seen_at timestamp, price_id string"


def test_latest_uses_seen_time_and_tie(spark):
    df = spark.createDataFrame([(1, 1, 10, 0, T1, T1, "b"), (1, 1, 11, 0, None, T2, "a"), (1, 1, 12, 0, T2, T1, "c")], PRICES)
    assert [r["price"] for r in P.latest_prices(df, "price_id").collect()] == [11]


def test_own_price_beats_cheaper_source(spark):
    latest = P.latest_prices(spark.createDataFrame([(1, 1, 50, 0, T1, T1, "a"), (1, 9, 10, 0, T2, T2, "b"), (2, 9, 7, 0, T2, T2, "c")], PRICES), "price_id")
    stores = spark.createDataFrame([(1, "a", "x", False), (9, "web", "x", True)], "id long, name string, chain string, is_online boolean")
    links = spark.createDataFrame([(1, 9)], "store_id long, source_store_id long")
    got = {(r["product_id"], r["store_id"]): r["price"] for r in P.latest_prices_fallback(latest, stores, links).collect()}
    assert got == {(1, 1): 50, (2, 1): 7, (1, 9): 10, (2, 9): 7}
    # the basket rule reads the source only
    only = {(r["product_id"], r["store_id"]): r["price"] for r in P.latest_prices_source_only(latest, stores, links).collect()}
    assert only[(1, 1)] == 10


def test_mirror_keeps_physical_rows(spark):
    fields = "product_id long, store_id long, price long, collected_at timestamp, source string"
    current = spark.createDataFrame([(1, 1, 50, T1, "physical"), (1, 2, 40, T1, "feed")], fields)
    batch = spark.createDataFrame([(1, 9, 10, T2, "web")], fields)
    stores = spark.createDataFrame([(1, "x", False), (2, "x", None), (3, "y", False), (9, "x", True)], "id long, chain string, is_online boolean")
    got = rows(P.mirror_prices(current, batch, stores).select("store_id", "price", "source"))
    assert got == [(1, 50, "physical"), (2, 10, "mirror:x:online")]


def test_grid_join_equals_all_pairs(spark):
    import math

    rng = random.Random(3)
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(120)]
    points += [(200 + i, 10.0, x) for i, x in enumerate((-179.99, 179.99, -179.5))] + [(300, 89.99, 0.0), (301, 89.99, 179.0)]
    shops = [(i, f"s{i}", "c", rng.uniform(-89, 89), rng.uniform(-180, 180), False) for i in range(300)]
    shops += [(400 + i, "w", "c", 10.0, x, False) for i, x in enumerate((-179.98, 179.98))] + [(500, "p", "c", 89.98, 90.0, False), (501, "n", "c", None, 1.0, False)]
    origins = spark.createDataFrame(points, "origin_id long, lat double, lon double")
    stores = spark.createDataFrame(shops, "id long, name string, chain string, lat double, lon double, is_online boolean")

    def km(a, b, c, d):
        h = math.sin(math.radians((c - a) / 2)) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians((d - b) / 2)) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    for radius in (5.0, 50.0, 900.0):
        got = {(r["origin_id"], r["store_id"]) for r in S.stores_within(origins, stores, radius).collect()}
        want = {(o, s[0]) for o, lat, lon in points for s in shops if s[3] is not None and km(lat, lon, s[3], s[4]) <= radius}
        assert got == want, radius


def _basket(spark, require_all):
    lines = spark.createDataFrame([(1, 10, 2), (1, 20, 1)], "basket_id long, product_id long, quantity long")
    near = spark.createDataFrame([(1, s, f"s{s}", c, d) for s, c, d in ((1, "A", 1.0), (2, "B", 2.0), (3, "A", 0.5), (4, "B", 3.0))], "basket_id long, store_id long, store_name string, chain string, distance_km double")
    offers = spark.createDataFrame([(11, 1, 100), (10, 1, 150), (20, 1, 30), (10, 2, 90), (20, 4, 60), (11, 4, 90)], "product_id long, store_id long, price long")
    members = spark.createDataFrame([(5, 10), (5, 11)], "group_id long, product_id long")
    return B.price_baskets(lines, near, offers, members, require_all)


def test_incomplete_basket_never_wins(spark):
    results = _basket(spark, False)
    got = {r["store_id"]: (r["total_price"], r["lines_found"], r["not_found"]) for r in results.collect()}
    assert got == {1: (230, 2, []), 2: (180, 1, ["20"]), 4: (240, 2, [])}  # store 3 has nothing
    ranked, winners = B.rank_baskets(results)
    assert [r["store_id"] for r in ranked.orderBy("rank").collect()] == [1, 4, 2]
    assert winners.first()["store_id"] == 1
    assert {r["store_id"]: r["total_price"] for r in _basket(spark, True).collect()} == {1: 230, 2: None, 4: 240}


def test_recipe_lines_join_their_chain(spark):
    lines = spark.createDataFrame([(1, 10, 2)], "basket_id long, product_id long, quantity long")
    near = spark.createDataFrame([(1, 1, "s", "A", 1.0)], "basket_id long, store_id long, store_name string, chain string, distance_km double")
    offers = spark.createDataFrame([(10, 1, 100)], "product_id long, store_id long, price long")
    members = spark.createDataFrame([], "group_id long, product_id long")
    recipe = spark.createDataFrame([(1, "a", "muna", 20, 3), (1, "a", "jahu", None, 1), (1, "b", "muna", 5, 3)], "basket_id long, chain string, ingredient string, price long, quantity long")
    row = B.price_baskets(lines, near, offers, members, True, recipe).first()
    assert (row["total_price"], row["lines_found"], row["required_lines"], row["not_found"]) == (260, 2, 3, ["jahu"])


def test_saved_winner(spark):
    results = _basket(spark, True)
    wanted = lambda s: spark.createDataFrame([(1, s)], "basket_id long, store_id long")
    assert B.saved_winner(results, wanted(4), 10000).first()["winner_store_id"] == 4
    assert B.saved_winner(results, wanted(99), 10000).first()["winner_store_id"] == 1
    assert B.saved_winner(results, wanted(2), 10000).first()["winner_total"] == 0


def test_normalize(spark):
    raw = spark.createDataFrame(
        [(1, " a ", 7, 2.0, None), (1, "a", 7, 0.0, ""), (1, "b", None, 0.05, None), (1, " B", None, 1.0, None), (1, "c", 8, -1.0, None), (1, " ", 9, 1.0, None), (1, "d", None, 1.0, "egg")],
        "basket_id long, product string, product_id long, quantity double, ingredient_name_en string",
    )
    by_id, by_name, recipe = B.normalize_baskets(raw)
    assert rows(by_id) == [(1, 7, 3.0)]
    assert rows(by_name) == [(1, "b", 1.1)]
    assert rows(recipe) == [(1, "d", "egg", 1.0)]


def test_recompare_uses_stored_radius(spark):
    saved = spark.createDataFrame([(1, 58.0, 24.0, 1.0, 500), (2, 58.0, 24.0, 40.0, 500)], "basket_id long, origin_lat double, origin_lon double, radius_km double, winner_total long")
    items = spark.createDataFrame([(1, 10, 1), (2, 10, 1)], "basket_id long, product_id long, quantity long")
    stores = spark.createDataFrame([(1, "a", "A", 58.0, 24.0, False), (2, "b", "B", 58.2, 24.0, False)], "id long, name string, chain string, lat double, lon double, is_online boolean")
    offers = spark.createDataFrame([(10, 1, 90), (10, 2, 70)], "product_id long, store_id long, price long")
    members = spark.createDataFrame([], "group_id long, product_id long")
    got = {r["basket_id"]: r["winner_total"] for r in B.recompare_baskets(saved, items, stores, offers, members).collect()}
    assert got == {1: 90, 2: 70}


def test_clamps():
    assert B.clamp(70.0, *B.RADIUS_KM) == 50.0 and B.clamp(0.0, *B.RADIUS_KM) == 0.1
    assert B.clamp_days(14) == 14 and B.clamp_days(15) == 30


def test_positions_number_all_rows(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k")
    got = rows(positions(df, "k", "i", slices=16).select("k", "i"))
    assert sorted(i for _, i in got) == list(range(1667)) and all(k == 3 * i for k, i in got)


def test_recipe_lines_count_for_every_chain(spark):
    """A store of a chain without any priced ingredient has the lines too, so
    its basket is incomplete."""
    lines = spark.createDataFrame([(1, 10, 1)], "basket_id long, product_id long, quantity long")
    near = spark.createDataFrame([(1, 1, "s", "A", 1.0), (1, 2, "t", "C", 2.0)], "basket_id long, store_id long, store_name string, chain string, distance_km double")
    offers = spark.createDataFrame([(10, 1, 100), (10, 2, 1)], "product_id long, store_id long, price long")
    members = spark.createDataFrame([], "group_id long, product_id long")
    items = spark.createDataFrame([(1, "egg", "muna", 2)], "basket_id long, ingredient string, product string, quantity long")
    per_chain = spark.createDataFrame([("egg", "a", 20)], "ingredient string, chain string, price long")
    results = B.price_baskets(lines, near, offers, members, True, R.basket_recipe_lines(items, per_chain, near))
    got = {r["store_id"]: (r["total_price"], r["lines_found"], r["required_lines"], r["not_found"]) for r in results.collect()}
    assert got == {1: (140, 2, 2, []), 2: (1, 1, 2, ["muna"])}
    assert [r["chain"] for r in B.chain_totals(results).collect()] == ["a"]


def test_stores_that_share_a_source_share_its_prices(spark):
    lines = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "basket_id long, product_id long, quantity long")
    near = spark.createDataFrame([(1, s, f"s{s}", "A", float(s)) for s in (1, 2, 3)], "basket_id long, store_id long, store_name string, chain string, distance_km double")
    offers = spark.createDataFrame([(10, 9, 5), (11, 9, 7), (10, 3, 1), (10, 1, 0)], "product_id long, store_id long, price long")
    members = spark.createDataFrame([], "group_id long, product_id long")
    sources = spark.createDataFrame([(1, 9), (2, 9), (3, 3)], "store_id long, source_store_id long")
    got = {r["store_id"]: (r["total_price"], r["lines_found"]) for r in B.price_baskets(lines, near, offers, members, sources=sources).collect()}
    assert got == {1: (17, 2), 2: (17, 2), 3: (None, 1)}


def test_a_late_row_does_not_replace_a_newer_copy(spark):
    shape = "product_id long, store_id long, price long, collected_at timestamp"
    at = lambda day: datetime(2024, 1, day)
    stores = spark.createDataFrame([(1, "A", True), (2, "A", False)], "id long, chain string, is_online boolean")
    first = P.mirror_prices(spark.createDataFrame([], shape + ", source string"), spark.createDataFrame([(5, 1, 20, at(20))], shape), stores)
    for price, day, want in ((10, 3, 20), (30, 20, 20), (15, 20, 15), (40, 21, 40)):
        assert P.mirror_prices(first, spark.createDataFrame([(5, 1, price, at(day))], shape), stores).first()["price"] == want


def test_groups_expand_without_comparing_all_pairs(spark):
    products = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "product_id long")
    members = spark.createDataFrame([(5, 1), (5, 1), (5, 3), (6, 2), (7, 2), (6, 4), (7, 4), (None, 9)], "group_id long, product_id long")
    expanded = B.expand_groups(products, members)
    assert rows(expanded) == sorted([(1, 1), (1, 3), (2, 2), (2, 4), (None, None)], key=repr)
    top = expanded._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union"  # no step over the pairs of all products


def test_mirror_spreads_without_moving_copies(spark):
    rng = random.Random(5)
    shops = [(i, rng.choice(["x", "y", None]), rng.choice([True, False, None])) for i in range(12)] + [(3, "y", False), (4, "x", False), (None, "x", False)]
    stores = spark.createDataFrame(shops + shops[:5], "id long, chain string, is_online boolean")
    fields = "product_id long, store_id long, price long, collected_at timestamp, source string"
    some = lambda n, kinds: [(rng.choice([*range(6), None]), rng.choice([*range(12), None]), rng.choice([1, 2, 3, None]), rng.choice([T1, T2, None]), rng.choice(kinds)) for _ in range(n)]
    have = list({r[:2]: r for r in some(60, ["physical", "feed", "mirror:x:online", None])}.values())
    current, batch = spark.createDataFrame(have, fields), spark.createDataFrame(some(60, ["web"]), fields)
    copies = P.pick_first(
        P.mirror_rows(batch, stores), ["product_id", "store_id"], F.col("collected_at").desc_nulls_last(), F.col("price").asc(), F.col("source").asc()
    )
    want, news = {}, [tuple(r) for r in copies.select("product_id", "store_id", "price", "collected_at", "source").collect()]
    out = []
    for p, s, *new in news:
        want[p, s] = new
    seen = lambda t: T1.replace(year=1900) if t is None else t
    for p, s, *old in have:
        new = want.pop((p, s), None) if p is not None and s is not None else None
        late = new and (old[2] or "").startswith("mirror:") and (
            seen(old[1]) > seen(new[1]) or seen(old[1]) == seen(new[1]) and None not in (old[0], new[0]) and old[0] <= new[0]
        )
        out.append((p, s, *(old if new is None or old[2] == "physical" or late else new)))
    out += [(p, s, *new) for (p, s), new in want.items()]
    assert rows(P.mirror_prices(current, batch, stores).select("product_id", "store_id", "price", "collected_at", "source")) == sorted(out, key=repr)
