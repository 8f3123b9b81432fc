"""Baskets priced inside the tasks against the same baskets priced pair by pair."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cartwise.operators import baskets as B
from cartwise.operators import reach as R
from cartwise.operators import stores as S


def _tables(spark, seed: int, twice: bool):
    rng = random.Random(seed)
    shops = [(i, f"s{i}", rng.choice(["A", "b ", " B", "", None]), 58.0 + rng.random() / 4, 24.0 + rng.random() / 2, i % 7 == 0) for i in range(40)]
    shops += [(90, "far", "A", -58.0, 24.0, False), (91, "none", "A", None, 24.0, False)]
    origins = [(i, 58.0 + rng.random() / 4, 24.0 + rng.random() / 2) for i in range(60)] + [(60, 58.1, 24.2), (61, 58.1, 24.2), (62, None, 24.0)]
    lines = [(rng.randrange(64), rng.choice([*range(12), 77, None]), rng.choice([1, 2, 5, None])) for _ in range(220)]
    offers = [(rng.randrange(12), rng.randrange(40), rng.choice([10, 20, 20, 30, None])) for _ in range(160)]
    members = [(100, 0), (100, 1), (100, 2), (101, 3), (101, 4)]
    sources = [(i, 7 * (i % 3) if i % 2 else i) for i, *_ in shops]
    recipe = [(b, c, w, rng.choice([3, 4, None]), 2) for b in range(0, 62, 3) for w in ("muna", "jahu") for c in ("a", "B ", " b", "zz")]
    make = lambda data, schema: spark.createDataFrame(data * 2 if twice else data, schema)
    return (
        make(shops, "id long, name string, chain string, lat double, lon double, is_online boolean"), make(origins, "basket_id long, lat double, lon double"),
        spark.createDataFrame(lines, "basket_id long, product_id long, quantity long"), spark.createDataFrame(offers, "product_id long, store_id long, price long"),
        spark.createDataFrame(members, "group_id long, product_id long"), make(sources, "store_id long, source_store_id long"),
        spark.createDataFrame(recipe, "basket_id long, chain string, ingredient string, price long, quantity long"),
    )


@pytest.mark.parametrize("seed, require_all, recipes, mapped, twice", [(1, True, False, True, False), (2, False, True, False, False), (3, True, True, True, False), (4, False, False, True, True)])
def test_reach_equals_pairs(spark, monkeypatch, seed, require_all, recipes, mapped, twice):
    stores, origins, lines, offers, members, sources, recipe = _tables(spark, seed, twice)
    monkeypatch.setattr(R, "PAIRS", 30)
    monkeypatch.setattr(R, "PART", 10)  # crowded cells are dealt into parts
    recipe, sources = recipe if recipes else None, sources if mapped else None
    near = S.stores_within(origins, stores, 10.0, None, "basket_id")
    pairs = B.price_baskets(lines, near, offers, members, require_all, recipe, sources).cache()
    price = lambda keep, wanted=None: B.price_baskets(lines, R.Reach(origins, stores, 10.0), offers, members, require_all, recipe, sources, keep, wanted)
    tidy = lambda df: rows(df.withColumn("distance_km", F.round("distance_km", 9)).select(*sorted(pairs.columns)))
    assert tidy(price("all")) == tidy(pairs) and pairs.count() > 100
    ranked, winners = B.rank_baskets(pairs)
    place = ["basket_id", "rank", "store_id", "total_price", "lines_found"]
    assert rows(B.rank_baskets(price("rank"))[0].select(*place)) == rows(ranked.select(*place))
    assert tidy(B.rank_baskets(price("winner"))[1]) == tidy(winners)
    slim = B.price_baskets(lines, R.Reach(origins, stores, 10.0), offers, members, require_all, recipe, sources, missing=False)
    assert rows(slim.drop("distance_km", "chain", "store_name")) == rows(pairs.select(*slim.drop("distance_km", "chain", "store_name").columns))
    assert rows(B.chain_totals(price("chain"))) == rows(B.chain_totals(pairs))
    assert rows(B.compare_summary(price("chain"))) == rows(B.compare_summary(pairs))
    wanted = origins.select("basket_id", (F.col("basket_id") % 40).alias("store_id")).distinct()
    assert rows(B.saved_winner(price("saved", wanted), wanted)) == rows(B.saved_winner(pairs, wanted))
    none = origins.select("basket_id", F.lit(None).cast("long").alias("store_id")).distinct()
    best = B.saved_winner(pairs, none)
    listed, _ = B.snapshot_baskets(B.price_lines(lines, near, offers, members, sources), price("list"), best)
    headers, _ = B.snapshot_baskets(B.price_lines(lines, near, offers, members, sources), pairs, best)
    sizes = ["basket_id", "winner_store_id", F.col("stores.store_id"), F.col("stores.total_price"), F.col("stores.lines_found"), F.col("stores.chain")]
    assert rows(listed.select(*sizes)) == rows(headers.select(*sizes))
    met = S.within_pairs(best.select("basket_id", F.col("winner_store_id").alias("store_id")), origins, stores, 10.0, "basket_id")
    won = near.join(best.select("basket_id", F.col("winner_store_id").alias("store_id")), ["basket_id", "store_id"], "left_semi")
    assert rows(met) == rows(won.select(*met.columns))
    pairs.unpersist()


def test_chains_fold_before_origins_are_looked_up(spark):
    stores, origins, *_ = _tables(spark, 5, True)
    origins = origins.unionByName(spark.createDataFrame([(3, 58.1, 24.2), (None, 58.1, 24.2)], origins.schema))
    want = S.nearby_chains(S.stores_within(origins, stores, 10.0, None, "basket_id"), "basket_id", {"a": "zz"})
    assert rows(S.chains_within(origins, stores, 10.0, "basket_id", {"a": "zz"})) == rows(want)
    rounded = S.stores_within(origins, stores, 10.0, None, "basket_id", digits=3)
    plain = S.stores_within(origins, stores, 10.0, None, "basket_id").withColumn("distance_km", F.round("distance_km", 3))
    assert rows(rounded) == rows(plain)
