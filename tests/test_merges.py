"""Keyed merges against row-by-row runs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from cartwise.operators import merges as M
from cartwise.operators import stores as S

T0 = datetime(2024, 1, 1)


def test_price_writer_does_not_depend_on_order(spark):
    rng = random.Random(9)
    feed = [(rng.randint(1, 4), rng.randint(1, 3), rng.randint(1, 9), T0 + timedelta(hours=rng.randint(0, 5))) for _ in range(200)]
    schema = "product_id long, store_id long, price long, seen_at timestamp"
    expected = {}
    for p, s, price, at in feed:
        old = expected.get((p, s))
        if old is None or at > old[1] or (at == old[1] and price < old[0]):
            expected[p, s] = (price, at)
    for order in (feed, feed[::-1], sorted(feed, key=lambda r: r[2])):
        current = history = spark.createDataFrame([], schema)
        for part in (order[:70], order[70:150], order[150:]):
            current, history = M.write_prices(current, history, spark.createDataFrame(part, schema))
        assert {(r[0], r[1]): (r[2], r[3]) for r in current.collect()} == expected
        assert history.count() == 200


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k long, name string, brand string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "")], "k long, name string, brand string")
    once = M.merge_coalesce(old, new, "k", blank=("brand",))
    assert rows(once) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert rows(M.merge_coalesce(once, new, "k", blank=("brand",))) == rows(once)
    over = M.merge_overwrite(old, new, "k")
    assert rows(over) == [(1, "a", "x"), (2, None, "y"), (3, "c", "")]
    assert rows(M.merge_overwrite(over, new, "k")) == rows(over)


def _sequential(existing, incoming):
    """The merge as one would do it item by item."""
    by_pid, by_ing, broken, taken = {}, {}, {}, set()
    for rid, pid, ing, name in existing:
        norm = name.strip().lower()
        taken.add(norm)
        if pid is not None:
            by_pid[pid] = rid
        elif ing is not None:
            by_ing[ing] = rid
        else:
            broken[norm] = max(rid, broken.get(norm, 0))
    out = {}
    for arrival, pid, ing, name in incoming:
        norm = name.strip().lower()
        if pid is None and not ing:
            out[arrival] = ("rejected", None)
            continue
        table, key = (by_pid, pid) if pid is not None else (by_ing, ing)
        if key in table:
            out[arrival] = ("skipped", None)
        elif norm in broken:
            out[arrival] = ("repaired", broken.pop(norm))
            table[key] = 1
        elif norm in taken:
            out[arrival] = ("skipped", None)
        else:
            out[arrival] = ("added", None)
            taken.add(norm)
            table[key] = -1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_basket_merge_equals_loop(spark, seed):
    rng = random.Random(seed)
    names = [" Piim", "piim ", "Sai", "Leib", "Juust", "Või", "Muna"]
    ident = lambda: rng.choice([(rng.randint(1, 6), None), (rng.randint(1, 6), "egg"), (None, rng.choice(["egg", "salt", "oil"])), (None, None), (None, "")])
    existing = [(i, *rng.choice([(rng.randint(1, 6), None), (None, "oil"), (None, None)]), rng.choice(names)) for i in range(1, 5)]
    incoming = [(100 + i, *ident(), rng.choice(names)) for i in range(60)]
    want = _sequential(existing, incoming)
    old = spark.createDataFrame([(7, *r) for r in existing], "family_id long, id long, product_id long, ingredient_name_en string, product_name string")
    new = spark.createDataFrame([(7, *r) for r in incoming], "family_id long, arrival long, product_id long, ingredient_name_en string, product_name string")
    got = {r["arrival"]: (r["outcome"], r["repairs"]) for r in M.merge_shared_baskets(old, new).collect()}
    assert got == want


@pytest.mark.parametrize("overwrite", [True, False])
def test_apply_eans_equals_loop(spark, overwrite):
    rng = random.Random(4)
    pool = [f"40063813339{i:02d}" for i in range(12)] + ["11111111", "00000000", "123", "", None]
    products = [(i, rng.choice(pool)) for i in range(1, 40)]
    found = [(i, rng.choice(pool[:13])) for i in range(1, 40)]
    state, want = dict(products), {}
    bad = lambda e: not e or not (e.isdigit() and len(e) in (8, 13)) or (len(set(e)) == 1 and len(e) == 8)
    start = dict(products)
    for pid, ean in found:
        prev = start[pid]
        if len(ean) == 8 and len(set(ean)) == 1:
            want[pid] = "BOGUS_CANDIDATE"
        elif prev and prev == ean:
            want[pid] = "EXISTS"
        elif prev and not overwrite:
            want[pid] = "SKIP_PRESENT"
        elif prev and not bad(prev):
            want[pid] = "SKIP_NOT_BAD"
        elif any(e == ean and p != pid for p, e in start.items()) or any(e == ean and p != pid for p, e in state.items()):
            want[pid] = "DUP_FOUND"
        else:
            want[pid] = "OVERWRITE" if prev else "OK"
            state[pid] = ean
    df = spark.createDataFrame(products, "id long, ean string")
    outcomes, after = M.apply_eans(df, spark.createDataFrame(found, "product_id long, ean string"), overwrite)
    assert {r["product_id"]: r["outcome"] for r in outcomes.collect()} == want
    assert {r["id"]: r["ean"] for r in after.collect()} == state
    queue = spark.createDataFrame([(1, 0, None), (99, 2, "old")], "product_id long, attempts int, last_error string")
    assert {r["product_id"]: r["attempts"] for r in M.queue_after(queue, outcomes).collect()} == {1: 1, 99: 2}


def test_upsert_products_makes_one_per_barcode(spark):
    products = spark.createDataFrame([(1, "111", "a")], "id long, ean string, name string")
    batch = spark.createDataFrame(
        [(10, "1-1-1", "x", None, None, 5, 100, T0), (11, "222", "y", None, None, 5, 200, T0), (12, "2 22", "z", None, None, 6, 300, T0), (13, None, "w", None, None, 5, 1, T0), (14, "", "w", None, None, 5, 2, T0)],
        "arrival long, ean_raw string, name string, size_text string, brand string, store_id long, price long, collected_at timestamp",
    )
    after, prices = M.upsert_products(products, batch)
    assert rows(after.select("id", "ean", "name")) == [(1, "111", "a"), (2, "222", "y"), (3, None, "w"), (4, None, "w")]
    assert rows(prices.select("product_id", "price")) == [(1, 100), (2, 200), (2, 300), (3, 1), (4, 2)]


def test_upsert_catalog(spark):
    products = spark.createDataFrame([(1, None, "i"), (2, "9", "")], "id long, ean string, image_url string")
    prices = spark.createDataFrame([(1, 5, 10, 8, T0, "old"), (1, 6, 10, 8, T0, "old")], "product_id long, store_id long, price long, promo_price long, collected_at timestamp, source string")
    links = spark.createDataFrame([("feed", "a", 1), ("feed", "b", 2), ("other", "c", 1)], "source string, ext_id string, product_id long")
    batch = spark.createDataFrame([("a", 20, None, "7", "new"), ("b", 0, None, "5", "new"), ("c", 3, None, "5", "new")], "ext_id string, price long, promo_price long, ean string, image_url string")
    goods, after = M.upsert_catalog(products, prices, links, batch, "feed", 5, "2024-02-01 00:00:00")
    assert rows(goods.select("id", "ean", "image_url")) == [(1, "7", "i"), (2, "9", "")]
    assert rows(after.select("product_id", "store_id", "price", "promo_price")) == [(1, 5, 20, None), (1, 6, 10, 8)]


def test_quantities_fill_only(spark):
    products = spark.createDataFrame([(1, "a", None, None, 1), (2, "b", 5.0, "g", 1)], "id long, name string, net_qty double, net_unit string, pack_count long")
    parsed = spark.createDataFrame([(1, 9.0, "ml", 2), (2, 7.0, "g", 3)], "id long, net_qty double, net_unit string, pack_count long")
    same, log = M.apply_quantities(products, parsed)
    assert rows(same) == rows(products) and log.count() == 1
    after, log = M.apply_quantities(products, parsed, commit=True)
    assert rows(after) == [(1, "a", 9.0, "ml", 2), (2, "b", 5.0, "g", 1)]
    assert log.first()["before"]["net_qty"] is None and log.first()["after"]["net_qty"] == 9.0


def test_erasure_passes_families_on(spark):
    families = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, owner_id long")
    members = spark.createDataFrame([(1, 10, 1), (1, 12, 3), (1, 11, 2), (2, 20, 1), (3, 30, 1), (3, 10, 2)], "family_id long, user_id long, joined_at long")
    gone = spark.createDataFrame([(10,), (20,)], "user_id long")
    kept = M.erase_users({"picks": members.select("user_id")}, families, members, gone)
    assert rows(kept["families"]) == [(1, 11), (3, 30)]
    assert rows(kept["family_members"].select("family_id", "user_id")) == [(1, 11), (1, 12), (3, 30)]
    assert {r[0] for r in kept["picks"].collect()} == {11, 12, 30}


def test_images_and_labels(spark):
    prices = spark.createDataFrame([("Piim", "Alma", None, "old", "Kontrolli visuaali!"), ("piim", None, None, None, "x")], "product string, manufacturer string, amount string, image_url string, note string")
    images = spark.createDataFrame([("PIIM", "", "", "p1", 1), ("piim", "ALMA", "", "p2", 2), ("Piim", "", "", "p3", 3)], "product string, manufacturer string, amount string, image_url string, arrival long")
    assert rows(M.apply_images(prices, images).select("product", "image_url", "note")) == [("Piim", "p2", ""), ("piim", "p3", "x")]
    flagged = M.flag_missing_images(spark.createDataFrame([("", ""), ("u", "")], "image_url string, note string"))
    assert rows(flagged.select("image_url", "note")) == [("u", ""), (None, "Kontrolli visuaali!")]
    assert rows(M.flag_missing_images(flagged)) == rows(flagged)


def test_online_store_is_ensured(spark):
    stores = spark.createDataFrame([(1, "a", "x", None, None, False, None)], "id long, name string, chain string, lat double, lon double, is_online boolean, address string")
    incoming = spark.createDataFrame([("x", "a", "street 1", 1.0, 2.0, False)], "chain string, name string, address string, lat double, lon double, is_online boolean")
    got = S.upsert_stores(stores, incoming, ["x"])
    assert rows(got.select("id", "chain", "is_online", "address")) == [(1, "x", False, "street 1"), (None, "x", True, None)]
