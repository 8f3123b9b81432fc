"""Nearest stores, against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows

from cartwise.operators import stores as S


def km(a, b):
    chord = math.sin(math.radians((b[0] - a[0]) / 2)) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians((b[1] - a[1]) / 2)) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(chord))


def spread(rng, n):
    """Points of a dense town, of others far apart, at the date line and near a pole."""
    out = []
    for _ in range(n):
        kind = rng.randint(0, 9)
        if kind < 5:
            out.append((59.4 + rng.gauss(0, 0.004), 24.7 + rng.gauss(0, 0.004)))
        elif kind < 7:
            out.append((59.4 + rng.uniform(-0.3, 0.3), 24.7 + rng.uniform(-0.6, 0.6)))
        elif kind == 7:
            out.append((rng.uniform(-0.05, 0.05), rng.choice([179.98, -179.97, 0.0]) + rng.uniform(-0.02, 0.02)))
        elif kind == 8:
            out.append((89.9 + rng.uniform(0, 0.09), rng.uniform(-180, 180)))
        else:
            out.append((-79.9 + rng.uniform(-0.15, 0.15), rng.uniform(10, 11)))
    return out


@pytest.mark.parametrize("radius", [12.0, 60.0])
def test_nearest_stores_are_those_of_all_pairs(spark, radius):
    rng = random.Random(int(radius))
    shops = [(i, rng.choice(["n", "m", None]), rng.choice("abc"), *p, rng.choice([False, None])) for i, p in enumerate(spread(rng, 900))]
    shops += [(5000, "n", "a", 59.4, 24.7, True), (5001, "n", "a", None, 24.7, False)] + [(6000 + i, "t", "a", 59.5, 24.8, False) for i in range(30)]
    origins = [(i, *p, rng.choice([1, 3, 20, 0, None]), rng.choice([0, 0, 2, None])) for i, p in enumerate(spread(rng, 150))]
    origins += [(900, 59.5, 24.8, 5, 3), (901, None, 24.0, 4, 2), (902, None, None, 3, None), (903, None, 1.0, None, 1), (904, 10.0, 10.0, 3, 0)]
    got = S.nearest_stores(
        spark.createDataFrame(origins, "origin_id long, lat double, lon double, wanted int, skip int"),
        spark.createDataFrame(shops, "id long, name string, chain string, lat double, lon double, is_online boolean"), radius,
    )
    want = []
    live = [s for s in shops if not s[5] and s[3] is not None and s[4] is not None]
    for i, lat, lon, wanted, skip in origins:
        if lat is None or lon is None:
            order = [(None, s) for s in sorted(live)]
        else:
            order = [(d, s) for s in live if (d := km((lat, lon), s[3:5])) <= radius]
            order.sort(key=lambda x: (x[0], x[1][2], x[1][1] is None, x[1][1] or "", x[1][0]))
        for place, (d, s) in enumerate(order[(skip or 0) : (skip or 0) + (wanted or 0)], 1):
            want.append((i, s[0], place))
    assert rows(got.select("origin_id", "store_id", "position")) == sorted(want, key=repr)


def test_a_dense_cell_is_read_in_its_ring_only(spark):
    """Origins in a crowded town meet few of its stores."""
    rng = random.Random(9)
    shops = spark.createDataFrame([(i, "n", "a", 59.4 + rng.uniform(0, 0.05), 24.7 + rng.uniform(0, 0.1), False) for i in range(4000)], "id long, name string, chain string, lat double, lon double, is_online boolean")
    origins = spark.createDataFrame([(i, 59.42 + i / 2000, 24.75, 3, 0) for i in range(20)], "origin_id long, lat double, lon double, wanted int, skip int")
    near = S.nearest_stores(origins, shops, 10.0)
    assert near.count() == 60
    assert near.agg({"distance_km": "max"}).first()[0] < 0.5
