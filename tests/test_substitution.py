"""Substitution rules and the whole decision against a plain pairwise run."""

from __future__ import annotations

import random
from datetime import datetime
from fractions import Fraction

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cartwise.functions import vocab
from cartwise.operators import substitution as X


@pytest.mark.parametrize(
    "sub, o, c, tier",
    [
        ("dairy_milk", ("ml", 1000, False), ("ml", 1000, False), "auto"),
        ("dairy_milk", ("ml", 1000, False), ("ml", 1500, False), "suggested"),
        ("dairy_milk", ("ml", 1000, False), ("ml", 2000, False), "incompatible"),
        ("dairy_milk", ("g", 1000, False), ("ml", 1000, False), "incompatible"),
        ("nowhere", ("g", 1000, False), ("g", 1000, False), "unknown"),
        ("dairy_milk", (None, None, False), ("g", 1000, False), "unknown"),
        ("dairy_yogurt_kefir", ("g", 480, True), ("g", 400, False), "suggested"),
        ("dairy_eggs", ("tk", 10, False), ("tk", 10, False), "auto"),
        ("dairy_eggs", ("tk", 10, False), ("tk", 11, False), "suggested"),
    ],
)
def test_quantity_tier(one, sub, o, c, tier):
    lit = lambda v, t: F.lit(v).cast(t)
    args = [x for side in (o, c) for x in (lit(side[0], "string"), lit(side[1], "decimal(28,6)"), F.lit(side[2]))]
    assert one(X.quantity_tier(F.lit(sub), *args)) == tier


WORDS = [""] * 12 + ["maasika", "metsmaasika", "laktoosivaba", "vegan", "2,5%", "3%", "gouda", "viski", "viil", "suitsu", "kana", "gluteenivaba"]


def _world(spark, seed):
    rng = random.Random(seed)
    codes = ["dairy_milk", "cheese_regular", "tea", "baby_other", "unruled"]
    groups = [(g, f"toode {rng.choice(WORDS)}", rng.choice(["Alma", None]), rng.choice(codes)) for g in range(1, 121)]
    products = []
    for g, *_ in groups:
        for k in range(rng.randint(1, 3)):
            products.append((g * 10 + k, f"nimi {rng.choice(WORDS)}", rng.choice([None, 0, 100, 100, 110, 110, 120, 150, 400, 200000]), rng.choice(["g"] * 6 + ["G ", "kg", "ml", "pack", "", None]), rng.choice([None, 1, 1, 1, 4])))
    members = [(p[0] // 10, p[0]) for p in products]
    prices = [(p[0], rng.randint(1, 6), rng.choice([0, 5, 7, 9])) for p in products for _ in range(rng.randint(0, 2))]
    stores = [(i, "AB"[i % 2]) for i in range(1, 7)]
    frames = (
        spark.createDataFrame(groups, "id long, canonical_name string, brand string, sub_code string"),
        spark.createDataFrame(members, "group_id long, product_id long"),
        spark.createDataFrame(products, "id long, name string, net_qty long, net_unit string, pack_count long"),
        spark.createDataFrame(prices, "product_id long, store_id long, price long"),
        spark.createDataFrame(stores, "id long, chain string"),
    )
    return (groups, members, products, prices, stores), frames


def _expected(world, facts):
    """Every request against every candidate, one by one."""
    groups, members, products, prices, stores = world
    chain_of = {i: c.lower() for i, c in stores}
    by_id = {p[0]: p for p in products}
    carried = {(p // 10, chain_of[s], p) for p, s, price in prices if price > 0}
    priced = {(g, c) for g, c, _ in carried}
    code = {g: s for g, _, _, s in groups}
    blank = lambda u: u is None or not u.strip()

    def base(p):
        unit = vocab.UNITS.get((p[3] or "").strip().lower())
        if p[2] is None or not 0 < p[2] <= 100000 or unit is None:
            return None
        return unit[0], Fraction(p[2]) * (p[4] or 1) * unit[1]

    out = {}
    for g, *_ in groups:
        mine = sorted(p for q, p in members if q == g)
        full = [p for p in mine if (by_id[p][2] or 0) > 0 and not blank(by_id[p][3])]
        o = by_id[(full or mine)[0]]
        for chain in ("a", "b"):
            if (g, chain) in priced:
                continue
            if not o[2] or not o[3]:
                out[g, chain] = ("no_quantity_data", None, 0, 0, 0)
                continue
            pool = []
            for h in sorted({x for x, c, _ in carried if c == chain and code[x] == code[g]}):
                goods = sorted((p for x, c, p in carried if (x, c) == (h, chain)), key=lambda p: ((by_id[p][3] or "").strip().lower() != o[3].strip().lower(), not (by_id[p][2] or 0) > 0, p))
                pool.append((h, by_id[goods[0]]))
            fitting, usable = 0, []
            for h, c in pool:
                ob, cb, limits = base(o), base(c), vocab.QUANTITY_LIMITS.get(code[g])
                if ob is None or cb is None or ob[0] != cb[0] or limits is None:
                    continue
                gap = abs(cb[1] - ob[1]) / ob[1] * 100
                if gap > limits[1]:
                    continue
                fitting += 1
                tier = "auto" if gap <= limits[0] and ((o[4] or 0) > 1) == ((c[4] or 0) > 1) else "suggested"
                of, cf = facts[g, o[0]], facts[h, c[0]]
                if not set(of["required"]) <= set(cf["required"]) or set(of["identity"]) != set(cf["identity"]):
                    continue
                hard = list(zip(of["hard"], cf["hard"]))
                if code[g] == "dairy_milk" and of["hard"][0] == "flavored":
                    hard = hard[:1]
                if any(a is not None and a != b for a, b in hard):
                    continue
                if tier == "auto" and (of["tags"] != cf["tags"] or code[g] in vocab.AUTO_DISABLED):
                    tier = "suggested"
                if code[g] in vocab.EXACT_ONLY and tier != "auto":
                    continue
                usable.append((tier != "auto", gap, h, tier))
            usable.sort()
            if not usable:
                out[g, chain] = ("no_eligible_candidates", None, len(pool), fitting, 0)
            else:
                kind = "auto_substitute" if usable[0][3] == "auto" else "suggested_substitute"
                out[g, chain] = (kind, usable[0][2], len(pool), fitting, len(usable))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_equal_pairwise_run(spark, seed):
    world, (groups, members, products, prices, stores) = _world(spark, seed)
    facts = {(r["group_id"], r["product_id"]): r["shape"].asDict(recursive=True) for r in X.profiles(groups, members, products).collect()}
    requests = X.gaps(groups, ["a", "b"], X.carried_products(prices, stores, members))
    decided, _ = X.decide(requests, groups, members, products, prices, stores)
    got = {}
    for r in decided.collect():
        got[r["group_id"], r["chain"]] = (r["decision_type"], r["substitute_group_id"], r["sql_candidate_count"], r["quantity_eligible_count"], r["trait_eligible_count"])
        parts = r["quantity_auto_count"] + r["quantity_suggested_count"] + r["quantity_incompatible_count"] + r["quantity_unknown_count"]
        assert parts == r["sql_candidate_count"]
        assert r["missing_rule"] + r["missing_candidate_quantity"] + r["unknown_unit"] == r["quantity_unknown_count"]
        assert r["unit_mismatch"] + r["outside_allowed_range"] == r["quantity_incompatible_count"]
    assert got == _expected(world, facts)
    assert {"auto_substitute", "suggested_substitute", "no_eligible_candidates", "no_quantity_data"} <= {v[0] for v in got.values()}


def test_verdict_outside_shortlist_is_refused(spark):
    _, (groups, members, products, prices, stores) = _world(spark, 1)
    requests = X.gaps(groups, ["a", "b"], X.carried_products(prices, stores, members))
    wrong = requests.withColumn("selected_group_id", F.lit(-5)).withColumn("semantic_match", F.lit(True))
    decided, _ = X.decide(requests, groups, members, products, prices, stores, wrong)
    kinds = {r[0] for r in decided.select("decision_type").distinct().collect()}
    assert "semantic_rejected" in kinds and not kinds & {"auto_substitute", "suggested_substitute"}


def test_cache_holds_for_version_and_time(spark):
    schema = "original_group_id long, chain string, substitution_rules_version int, substitute_group_id long, decision_type string, included_in_total boolean, quantity_diff_percent double, expires_at timestamp"
    late, early = datetime(2024, 1, 9), datetime(2024, 1, 1)
    cache = spark.createDataFrame([(1, "a", vocab.RULES_VERSION, 5, "auto_substitute", True, 0.0, late), (2, "a", vocab.RULES_VERSION, 5, "auto_substitute", True, 0.0, early), (3, "a", vocab.RULES_VERSION - 1, 5, "auto_substitute", True, 0.0, late)], schema)
    requests = spark.createDataFrame([(i, "a") for i in (1, 2, 3, 4)], "group_id long, chain string")
    live = spark.createDataFrame([(5, "a", 42)], "group_id long, chain string, price long")
    hits, rest = X.reuse_decisions(requests, cache, "2024-01-05 00:00:00", live)
    assert rows(hits.select("group_id", "price")) == [(1, 42)]
    assert rows(rest.select("group_id")) == [(2,), (3,), (4,)]
    new = spark.createDataFrame([(2, "a", 6, "suggested_substitute", False, 1.0)], "group_id long, chain string, substitute_group_id long, decision_type string, included_in_total boolean, quantity_diff_percent double")
    merged = X.merge_decisions(cache, new, "2024-01-05 00:00:00")
    assert merged.count() == 3
    assert merged.filter("original_group_id = 2").first()["expires_at"] == datetime(2024, 1, 7)


def test_shadow_sample_is_stable_and_capped(spark):
    missing = spark.range(2000).select((F.col("id") % 100).alias("request_id"), "id", (F.col("id") % 7).alias("group_id"), F.lit("tea").alias("sub_code"), F.lit("A").alias("chain"), F.lit(1).alias("first_seen_store_id")).withColumnRenamed("id", "position")
    first, again = (rows(X.shadow_sample(missing, ["tea"], rate=0.5)) for _ in range(2))
    assert first == again and first
    per = {}
    for r in first:
        per[r[0]] = per.get(r[0], 0) + 1
    assert max(per.values()) <= 2 and len(per) < 100
