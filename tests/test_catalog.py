"""Search, alternatives, brand filters, analytics edges, files and streams."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from words import best_extent

from cartwise.functions import web
from cartwise.functions.names import unaccent
from cartwise.operators import catalog as C
from cartwise.operators import demand as D
from cartwise.operators import recipes as R
from cartwise.operators import textsearch
from cartwise.sources import files

T0 = datetime(2024, 1, 1)


def test_many_searches_equal_one_by_one(spark):
    texts = ["punane õun kg", "roheline oun", "piim 2,5", "ab", "hapukoor", None]
    grouped = spark.createDataFrame([(i, t, "grupp õ" if i % 2 else None) for i, t in enumerate(texts)], "id long, a string, b string").select(
        "id", unaccent(F.lower("a")).alias("search_text"), unaccent(F.lower("b")).alias("group_search_text")
    )
    asked = ["OUN", "õun kg", "kg grupp", "p", "ko ap", "un na", "zz", "ab", "õ grupp"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    got = {(r["query_id"], r["id"]) for r in C.token_search_join(queries, grouped).collect()}
    want = {(i, r["id"]) for i, q in enumerate(asked) for r in C.token_search(grouped, q).collect()}
    assert got == want and want


def test_requests_for_alternatives_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    products = spark.createDataFrame([(1, "red tea", "dry_other"), (2, "green tea", "dry_other")], "id long, name string, sub_code string")
    members = spark.createDataFrame([], "group_id long, product_id long")
    grouped = C.with_group(products, members, spark.createDataFrame([], "id long, canonical_name string, sub_code string, brand string"))
    prices = spark.createDataFrame([(1, 2, 5, 0, T0, "a"), (2, 2, 4, 0, T0, "b")], "product_id long, store_id long, price long, promo_price long, collected_at timestamp, price_id string")
    source = spark.createDataFrame([(1, 2)], "store_id long, source_store_id long")
    form = "request_id long, product_name string, store_id long"
    requests = spark.createDataFrame([(1, "red tea", 1), (1, "red tea", 1), (2, "green tea", 1), (3, "tea", 1), (4, None, 1), (5, "tea", 9)], form)
    got = C.alternatives(requests.mapInPandas(counted, form), grouped, prices, source, "2024-01-01 12:00:00", 7, 4).collect()
    assert sorted((r["request_id"], r["position"], r["id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (1, 2, 2), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
    assert made.value == 6


def test_only_distinct_texts_are_cut_into_trigrams(spark):
    left = spark.createDataFrame([("c", "red tea")] * 3, "code string, wanted string")
    right = spark.createDataFrame([("c", "green tea")] * 3, "code string, shown string")
    met = textsearch.shared_grams(left, right, "code")
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    assert [(r["wanted"], r["shown"]) for r in met.collect()] == [("red tea", "green tea")]


def test_alternatives_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["tomat", "kirsstomat", "kartul", "sibul", "ploomtomat", "kurk", "oliiv", "punane", "suur"]
    products = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice(["produce_root_veg", "dry_other"])) for i in range(60)]
    members = [(i - i % 2, i) for i in range(40)]
    groups = [(g, products[g][1] + " ühine", products[g][2], "Alma") for g in range(0, 40, 2)]
    prices = [(i, rng.randint(1, 3), rng.randint(1, 5), rng.choice([0, 0, 2]), T0 - timedelta(days=rng.randint(0, 9)), f"p{k:04d}") for k, i in enumerate(rng.choices(range(60), k=300))]
    requests = [(k, rng.choice(products)[1], rng.randint(1, 3)) for k in range(25)]
    df = spark.createDataFrame(products, "id long, name string, sub_code string")
    grouped = C.with_group(df, spark.createDataFrame(members, "group_id long, product_id long"), spark.createDataFrame(groups, "id long, canonical_name string, sub_code string, brand string"))
    tables = (
        spark.createDataFrame(prices, "product_id long, store_id long, price long, promo_price long, collected_at timestamp, price_id string"),
        spark.createDataFrame([(1, 2), (2, 2), (3, 3)], "store_id long, source_store_id long"),
    )
    asked = spark.createDataFrame(requests, "request_id long, product_name string, store_id long")
    got = C.alternatives(asked, grouped, *tables, "2024-01-01 12:00:00", 7, 4)
    got = {(r["request_id"], r["position"]): (r["id"], round(r["similarity"], 9), r["price"]) for r in got.collect()}

    facts = {r["id"]: r.asDict() for r in grouped.collect()}
    plain = str.maketrans("äöõüšž", "aoousz")
    shown = lambda f: (f["canonical_name"] or f["name"])
    code = lambda f: f["group_sub_code"] or f["sub_code"]
    from cartwise.functions import vocab

    def family(name):
        hits = [(p, f) for f, stems, p in vocab.PRODUCE_FAMILIES if any(s in name.lower() for s in stems)]
        top = [f for p, f in hits if p == max(h[0] for h in hits)]
        return top[0] if len(top) == 1 else None

    stems = {f: s for f, s, _ in vocab.PRODUCE_FAMILIES}
    want = {}
    for rid, wanted, store in requests:
        low = wanted.lower()
        tiers = sorted((0 if f["name"].lower() == low else 1 if (f["canonical_name"] or "").lower() == low else 2, i) for i, f in facts.items() if low in f["name"].lower() or low in (f["canonical_name"] or "").lower())
        category = code(facts[tiers[0][1]])
        fam = family(wanted) if category in vocab.FAMILY_FILTER_CATEGORIES else None
        query = (stems[fam][0] if fam else wanted).lower().translate(plain)
        source = {1: 2, 2: 2, 3: 3}[store]
        latest = {}
        for p, s, price, promo, at, pid in prices:
            if s == source and at > T0 + timedelta(hours=12) - timedelta(days=7) and (p not in latest or (at, pid) > latest[p][:2]):
                latest[p] = (at, pid, promo or price)
        best = {}
        for p, (_, _, price) in latest.items():
            f = facts[p]
            if code(f) != category or (fam and not any(s in f["name"].lower() or s in (f["canonical_name"] or "").lower() for s in stems[fam])):
                continue
            row = (-best_extent(query, shown(f).lower().translate(plain)), price, p, f["name"])
            best[f["dedup_key"]] = min(best.get(f["dedup_key"], row), row)
        for n, (sim, price, p, _) in enumerate(sorted(best.values(), key=lambda r: (r[0], r[1], r[3], r[2]))[:4], 1):
            want[rid, n] = (p, round(-sim, 9), price)
    assert got == want


def test_brand_filter_reasons(spark):
    rows_ = [("fish_fresh", "A")] * 9 + [("none", "A")] + [("few", "A")] * 3 + [("thin", b) for b in "AAABBB"] + [("thin", None)] * 5 + [("good", b) for b in "AAABBB"] + [("good", "")]
    groups = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(rows_)], "id long, sub_code string, brand string")
    rollup = groups.filter("sub_code <> 'none'").select(F.col("id").cast("string").alias("dedup_key"), F.lit(1).alias("min_price"))
    got = {r["sub_code"]: (r["reason"], r["available"], r["brands"], r["total_groups"]) for r in C.brand_filter(groups, rollup).collect()}
    assert got["fish_fresh"] == ("blocked_category", False, "", 0)
    assert got["none"][0] == "no_visible_groups"
    assert got["few"][0] == "insufficient_brands"
    assert got["thin"][0] == "insufficient_coverage"
    assert got["good"] == (None, True, "A,B", 7)


def test_display_row_hides_shown_size(spark):
    rows_ = spark.createDataFrame([(1, None, "Piim 500 ml", None, " x ", "500 ml", "s", ["b", "a", "a"], 5), (2, 7, "Tomat 1 kg", "Tomat", None, "KG", "s", None, None)],
                                  "id long, group_id long, name string, canonical_name string, group_brand string, size_text string, sub_code string, chains array<string>, min_price long")
    one, two = sorted(C.safe_product(rows_).collect(), key=lambda r: r["id"])
    assert (one["size_text"], one["brand"], one["available_chains"], one["is_per_kg"]) == ("", "x", ["a", "b"], False)
    assert (two["name"], two["size_text"], two["is_per_kg"], two["available_chains"]) == ("Tomat", "KG", True, [])


def test_momentum_edges(spark):
    counts = spark.createDataFrame([("a", 2, 0), ("b", 3, 0), ("c", 3, 1), ("d", 4, 2), ("e", 4, 4)], "k string, current_cnt long, prev_cnt long")
    assert [(r["k"], r["growth"]) for r in D.momentum(counts, "k").collect()] == [("d", 100.0), ("b", None)]


def test_sensitivity_bucket_edges(spark):
    gaps = [0, 0.50, 0.51, 1.00, 2.00, 2.01]
    events = [json.dumps({"cheapest_chain": "A", "cheapest_total": 10.0, "chain_totals": {"A ": 10.0, "b": 10.0 + g}}) for g in gaps] * 5 + ["{}", "no json"]
    got = {r["chain"]: r.asDict() for r in D.price_sensitivity(spark.createDataFrame([(e,) for e in events], "payload string"), ["a", "b"]).collect()}
    assert [got["b"][f"near_loss_{k}"] for k in ("050", "100", "200")] == [5, 10, 5]
    assert [got["a"][f"near_win_{k}"] for k in ("050", "100", "200")] == [5, 10, 5]
    assert got["a"]["wins"] == 30 and got["b"]["wins"] == 0
    few = spark.createDataFrame([(e,) for e in events[:20]], "payload string")
    assert D.price_sensitivity(few, ["a", "b"]).count() == 0


def test_latency_ranks(spark):
    rng = random.Random(2)
    values = [round(rng.expovariate(0.02), 1) for _ in range(501)]
    df = spark.createDataFrame([("x", v) for v in values], "k string, latency_ms double")
    got = D.latency_report(df, ["k"]).first()
    for share, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")):
        assert got[name] == sorted(values)[round(share * 500)]


def test_recipes(spark):
    lookup = spark.createDataFrame([("milk", ["PIIM"], []), ("egg", ["muna"], ["dairy_eggs"])], "ingredient string, search_terms array<string>, sub_codes array<string>")
    products = spark.createDataFrame([(1, "Täispiim", "dairy_milk", "barbora"), (2, "piimapesu", "hh_cleaners", "rimi"), (3, "Muna", "dairy_eggs", "rimi"), (4, "piim valmistoit", "x", "rimi"), (5, "Piim", "x", "maxima")], "id long, name string, sub_code string, chain string")
    prices = spark.createDataFrame([(i, 1, 10 - i, 0, T0) for i in range(1, 6)], "product_id long, store_id long, price long, promo_price long, collected_at timestamp")
    found = R.ingredient_candidates(lookup, products)
    assert rows(found.select("ingredient", "id")) == [("egg", 3), ("milk", 1), ("milk", 5)]
    per = R.ingredient_prices(found, prices, "2024-01-02 00:00:00", aliases={"barbora": "maxima"})
    assert rows(per.select("ingredient", "chain", "price")) == [("egg", "rimi", 7), ("milk", "maxima", 5)]
    items = spark.createDataFrame([(1, "milk"), (1, "egg")], "recipe_id long, ingredient string")
    near = spark.createDataFrame([(1, "barbora", 2.0)], "recipe_id long, chain string, distance_km double")
    got = R.price_recipes(items, per, near, {"barbora": "maxima"}).collect()
    assert [(r["chain"], r["covered"], r["total"], r["not_found"]) for r in got] == [("maxima", 1, 2, ["egg"])]


def test_page_shapes(spark):
    html = (
        '<script type="application/ld+json">{"@type":["Thing","Product"],"offers":[{"price":"1.20"}],"brand":"Alma","manufacturer":{"name":" AS X "}}</script>'
        '<script type="application/ld+json">broken</script>'
        '<script type="application/ld+json">[{"@type":"BreadcrumbList","itemListElement":[{"name":"Pood"},{"item":"https://x/piim"}]}]</script>'
        '<meta content="https://i/placeholder.png" property="og:image"><img src="https://i/a.jpg" class="x wp-post-image">'
    )
    row = web.extract_jsonld(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row["price"], row["brand"], row["manufacturer"], row["crumbs"]) == ("1.20", "Alma", "AS X", ["Pood", "piim"])
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert df.select(web.extract_image_url(F.col("html")).alias("u")).first()["u"] == "https://i/a.jpg"
    card = '<div data-gtm-eec-product="{&quot;id&quot;:&quot;7&quot;,&quot;name&quot;:&quot;Juust kg&quot;,&quot;price&quot;:9.99}"><div class="price-label"><div class="price-label__price"><span class="major">2</span><span class="cents">49</span></div></div></div><div data-gtm-eec-product="{&quot;id&quot;:&quot;8&quot;,&quot;name&quot;:&quot;Kala&quot;,&quot;price&quot;:9.99}"><span class="sr-only">x per kg</span></div>'
    got = web.extract_cards(spark.createDataFrame([(1, card)], "page_id long, html string")).collect()
    assert [(r["ext_id"], r["price"]) for r in got] == [("7", 2.49), ("8", None)]
    state = {"props": {"pageProps": {"apolloState": {"Product:1": {"__typename": "Product", "ean": "47400000", "name": "Liha", "price": 9.0, "approxPrice": True, "comparisonPrice": 12.5, "comparisonUnit": "kg"}, "Product:2": {"__typename": "Product", "ean": "1", "name": "x", "price": 1}}}}}
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'
    got = web.extract_next_data(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(r["ean"], r["price"], r["size_text"]) for r in got] == [("47400000", 12.5, "kg")]


def test_files(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "a.csv").write_text("﻿product_id,canonical_main_code,canonical_sub_code\n1, m , s\n2,,s\nx9,m,s\n", encoding="utf-8")
    updates, uncertain = files.load_labels(spark, str(folder))
    assert rows(updates.select("product_id", "main_code", "sub_code", "source_file")) == [(1, "m", "s", "a.csv"), (2, None, "s", "a.csv")]
    assert [r["product_id"] for r in uncertain.collect()] == ["2"]
    (tmp_path / "pairs.tsv").write_text("rimi_id\tprisma_id\n1\t2\nx\t3\n")
    assert rows(files.load_pairs(spark, str(tmp_path / "pairs.tsv"))) == [(1, 2)]
    (tmp_path / "list.txt").write_text("# head\n\nLiha -> https://x/smc/12/?a\nhttps://x/smc/34/?categoryName=Piim+ja%20sai\nhttps://x/none\n")
    assert rows(files.parse_category_urls(files.load_list(spark, str(tmp_path / "list.txt")))) == [("Liha", "12"), ("Piim ja sai", "34")]
    with pytest.raises(ValueError):
        files.ingest_csv(spark.createDataFrame([("1",)], "ext_id string"))
    sheet = spark.createDataFrame([(" Piim", "A", "1l", "1,5"), ("", "A", "1l", "x")], ["Toode", "Tootja", "Kogus", "Hind (€)"])
    data, checks = files.load_price_sheet(sheet, "rimi_tartu_tooted.xlsx")
    assert tuple(checks.first()) == (1, 1) and data.first()["store_name"] == "Rimi Tartu"
    out = str(tmp_path / "export")
    files.export_csv(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), out, ["id", "name"], newest="id", sep=";", bom=True)
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "export").glob("*.csv")))
    assert text.startswith("﻿id;name") and text.index("2;b") < text.index("1;a")
    rows_ = spark.createDataFrame([("1", "https://x/p/1?a"), ("2", "https://x/p/2#b"), ("3", "https://x/c")], "ext_id string, url string")
    listed = lambda *lines: spark.createDataFrame([(line,) for line in lines], "line string")
    assert rows(files.apply_skip_only(rows_, listed("https://x/p/1#z", "3"), None).select("ext_id")) == [("2",)]
    assert rows(files.apply_skip_only(rows_, None, listed("https://x/c?q", "2")).select("ext_id")) == [("2",), ("3",)]
