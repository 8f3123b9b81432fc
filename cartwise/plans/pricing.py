"""Queries over prices, stores and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators import baskets as B
from cartwise.operators import prices as P
from cartwise.operators import stores as S
from cartwise.operators.reach import Reach
from cartwise.plans.registry import query
from cartwise.sources.adapters import PRICE_AS_OF, Tables

RADIUS_KM = 10.0
CHAINS = ["africa", "america", "asia", "europe", "middle east"]

LATEST = """
latest AS (
  SELECT product_id, store_id, price, promo_price, coalesce(collected_at, seen_at) AS collected_at
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id
          ORDER BY coalesce(collected_at, seen_at) DESC NULLS LAST, price_id ASC) AS rn FROM prices) ranked
  WHERE rn = 1)
"""

SOURCE = """
source AS (
  SELECT s.id AS store_id, coalesce(m.source_store_id, s.id) AS source_store_id
  FROM stores s LEFT JOIN (SELECT store_id, min(source_store_id) AS source_store_id FROM store_price_source GROUP BY store_id) m
    ON m.store_id = s.id)
"""

DISTANCE = """2*6371*asin(sqrt(pow(sin(radians((s.lat-o.lat)/2)),2)+cos(radians(o.lat))*cos(radians(s.lat))*pow(sin(radians((s.lon-o.lon)/2)),2)))"""

NEAR = f"""
near AS (
  SELECT o.basket_id, s.id AS store_id, s.name AS store_name, s.chain, {DISTANCE} AS distance_km
  FROM basket_origins o JOIN stores s ON s.lat IS NOT NULL AND s.lon IS NOT NULL AND NOT s.is_online
  WHERE {DISTANCE} <= {RADIUS_KM})
"""

PRICED = f"""
{LATEST}, {SOURCE}, {NEAR},
offers AS (
  SELECT l.product_id, s.store_id, CASE WHEN l.promo_price <> 0 THEN l.promo_price ELSE l.price END AS price
  FROM latest l JOIN source s ON s.source_store_id = l.store_id),
keyed_offers AS (
  SELECT coalesce(CAST(m.group_id AS VARCHAR), concat('u_', o.product_id)) AS k, o.store_id, min(o.price) AS price
  FROM offers o LEFT JOIN product_group_members m ON m.product_id = o.product_id GROUP BY 1, 2),
lines AS (
  SELECT n.basket_id, n.store_id, n.store_name, n.chain, n.distance_km, b.product_id, b.quantity, k.price
  FROM near n JOIN (SELECT b.*, coalesce(CAST(m.group_id AS VARCHAR), concat('u_', b.product_id)) AS k
                    FROM baskets b LEFT JOIN product_group_members m ON m.product_id = b.product_id) b ON b.basket_id = n.basket_id
  LEFT JOIN keyed_offers k ON k.k = b.k AND k.store_id = n.store_id),
results AS (
  SELECT basket_id, store_id, min(chain) AS chain, min(distance_km) AS distance_km,
         CAST(count(price) AS BIGINT) AS lines_found, CAST(count(*) AS BIGINT) AS required_lines,
         CASE WHEN count(price) = count(*) THEN CAST(sum(price * quantity) AS BIGINT) END AS total_price,
         string_agg(CASE WHEN price IS NULL THEN CAST(product_id AS VARCHAR) END, ',' ORDER BY CAST(product_id AS VARCHAR)) AS not_found
  FROM lines GROUP BY basket_id, store_id HAVING count(price) > 0)
"""


def latest(t: Tables) -> DataFrame:
    return P.latest_prices(t.prices, "price_id")


def offers(t: Tables) -> DataFrame:
    return P.latest_prices_source_only(latest(t), t.stores, t.store_price_source)


def sources(t: Tables) -> DataFrame:
    return S.effective_source(t.stores, t.store_price_source)


def near(t: Tables) -> DataFrame:
    return S.stores_within(t.basket_origins, t.stores, RADIUS_KM, None, "basket_id")


def reach(t: Tables) -> Reach:
    return Reach(t.basket_origins, t.stores, RADIUS_KM)


def lines(t: Tables) -> DataFrame:
    """Basket lines with the key of their offers."""
    return B.keyed_lines(t.keyed_baskets(B.offer_keys(t.product_group_members))).select("basket_id", "product_id", "quantity", "offer_key")


def results(t: Tables, keep: str = "all", wanted: DataFrame | None = None, missing: bool = False) -> DataFrame:
    """Priced baskets; `keep` says which of a basket's stores a query goes on with."""
    return B.price_baskets(
        lines(t), reach(t), P.latest_offers(t.prices, "price_id"), t.product_group_members, sources=sources(t), keep=keep, wanted=wanted, missing=missing,
    )


@query("ag01_latest_prices", f"""
WITH {LATEST}
SELECT product_id, store_id, price, CAST(epoch(collected_at) AS BIGINT) AS at FROM latest""")
def _latest(t: Tables) -> DataFrame:
    return latest(t).select("product_id", "store_id", "price", F.unix_seconds(F.col("collected_at").cast("timestamp")).alias("at"))


FALLBACK = f"""
{LATEST}, {SOURCE},
fallback AS (
  SELECT product_id, store_id, price, collected_at, priority FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY priority) AS rn FROM (
      SELECT l.product_id, l.store_id, l.price, l.collected_at, 1 AS priority FROM latest l JOIN stores s ON s.id = l.store_id
      UNION ALL
      SELECT l.product_id, s.store_id, l.price, l.collected_at, 2 AS priority
      FROM source s JOIN latest l ON l.store_id = s.source_store_id) u) r WHERE rn = 1)
"""


@query("ag02_latest_prices_fallback", f"""
WITH {FALLBACK}
SELECT product_id, store_id, price, CAST(epoch(collected_at) AS BIGINT) AS at, CAST(priority AS BIGINT) AS priority FROM fallback""")
def _fallback(t: Tables) -> DataFrame:
    rows = P.latest_prices_fallback(latest(t), t.stores, t.store_price_source)
    return rows.select(
        "product_id", "store_id", "price", F.unix_seconds(F.col("collected_at").cast("timestamp")).alias("at"),
        F.col("priority").cast("long").alias("priority"),
    )


@query("st01_union_prices", f"""
WITH {LATEST}, {SOURCE}
SELECT CAST(priority AS BIGINT) AS priority, CAST(count(*) AS BIGINT) AS n, CAST(sum(price) AS BIGINT) AS total FROM (
  SELECT 1 AS priority, price FROM latest UNION ALL
  SELECT 2, l.price FROM latest l JOIN source s ON s.source_store_id = l.store_id WHERE s.store_id <> s.source_store_id) u
GROUP BY priority""")
def _union(t: Tables) -> DataFrame:
    own = latest(t).select("product_id", "store_id", "price")
    mapped = S.effective_source(t.stores, t.store_price_source).filter("store_id <> source_store_id")
    borrowed = own.withColumnRenamed("store_id", "source_store_id").join(mapped, "source_store_id").drop("source_store_id")
    both = P.union_prices(own, borrowed)
    return both.groupBy(F.col("priority").cast("long").alias("priority")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("ag03_latest_prices_source_only", f"""
WITH {LATEST}, {SOURCE}
SELECT l.product_id, s.store_id, CASE WHEN l.promo_price <> 0 THEN l.promo_price ELSE l.price END AS price
FROM latest l JOIN source s ON s.source_store_id = l.store_id""")
def _source_only(t: Tables) -> DataFrame:
    return offers(t).select("product_id", "store_id", "price")


CHEAPEST = """
SELECT product_id, store_id, price FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price ASC, collected_at DESC NULLS LAST, store_id ASC) AS r
  FROM {rows}) x WHERE r = 1"""


@query("ag04_cheapest_offer", f"WITH {FALLBACK} {CHEAPEST.format(rows='fallback')}")
def _cheapest(t: Tables) -> DataFrame:
    rows = P.latest_prices_fallback(latest(t), t.stores, t.store_price_source)
    return P.cheapest_offer(rows).select("product_id", "store_id", "price")


@query("ag05_cheapest_offer_ordered_aggregate", f"""
WITH {LATEST}
SELECT product_id, store_id, price AS min_price FROM ({CHEAPEST.format(rows='latest')}) c""")
def _cheapest_agg(t: Tables) -> DataFrame:
    return P.cheapest_offer_agg(latest(t)).select("product_id", "store_id", "min_price")


@query("ag06_cheapest_within_radius", f"""
WITH {LATEST}, inside AS (
  SELECT l.* FROM latest l JOIN (
    SELECT s.id FROM stores s CROSS JOIN (SELECT 58.5E0 AS lat, 25.0E0 AS lon) o
    WHERE s.lat IS NOT NULL AND s.lon IS NOT NULL AND {DISTANCE} <= 40.0) n ON n.id = l.store_id)
{CHEAPEST.format(rows='inside')}""")
def _cheapest_within(t: Tables) -> DataFrame:
    return P.cheapest_within(latest(t), t.stores, 58.5, 25.0, 40.0).select("product_id", "store_id", "price")


@query("jn02_expand_groups", """
SELECT b.product_id, m2.product_id AS member_id
FROM (SELECT DISTINCT product_id FROM baskets) b
JOIN product_group_members m1 ON m1.product_id = b.product_id JOIN product_group_members m2 ON m2.group_id = m1.group_id
UNION
SELECT b.product_id, b.product_id FROM (SELECT DISTINCT product_id FROM baskets) b
WHERE NOT EXISTS (SELECT 1 FROM product_group_members m WHERE m.product_id = b.product_id)""")
def _expand(t: Tables) -> DataFrame:
    return B.expand_groups(t.baskets, t.product_group_members)


@query("jn03_effective_source", f"WITH {SOURCE} SELECT store_id, source_store_id FROM source")
def _source(t: Tables) -> DataFrame:
    return S.effective_source(t.stores, t.store_price_source)


@query("jn04_group_info", """
SELECT product_id, group_id, sub_code FROM (
  SELECT m.product_id, m.group_id, g.sub_code, row_number() OVER (PARTITION BY m.product_id ORDER BY m.group_id) AS r
  FROM product_group_members m JOIN product_groups g ON g.id = m.group_id
  WHERE g.sub_code IS NOT NULL AND m.product_id IN (SELECT product_id FROM baskets)) x WHERE r = 1""")
def _group_info(t: Tables) -> DataFrame:
    return B.group_info(t.baskets, t.product_group_members, t.product_groups)


@query("jn05_stores_within_radius", f"""
WITH {NEAR} SELECT basket_id, store_id, chain, round(distance_km, 6) AS distance_km FROM near""")
def _near(t: Tables) -> DataFrame:
    rows = S.stores_within(t.basket_origins, t.stores, RADIUS_KM, None, "basket_id", digits=6)
    return rows.select("basket_id", "store_id", "chain", "distance_km")


@query("jn05_nearest_three_stores", f"""
WITH {NEAR} SELECT basket_id, store_id FROM (
  SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY distance_km, chain, store_name, store_id) AS r FROM near) x WHERE r <= 3""")
def _nearest(t: Tables) -> DataFrame:
    origins = t.basket_origins.withColumns({"wanted": F.lit(3), "skip": F.lit(0)})
    return S.nearest_stores(origins, t.stores, RADIUS_KM, "basket_id").select("basket_id", "store_id")


@query("jn05_stores_by_request", f"""
WITH asked AS (SELECT *, basket_id % 5 AS wanted, basket_id % 3 AS skip, basket_id % 7 = 0 AS nowhere FROM basket_origins), {NEAR},
shops AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM stores WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT is_online),
placed AS (SELECT basket_id, store_id, round(distance_km, 6) AS distance_km, row_number() OVER (PARTITION BY basket_id ORDER BY distance_km, chain, store_name, store_id) AS r FROM near)
SELECT a.basket_id, p.store_id, p.distance_km, CAST(p.r - a.skip AS INTEGER) AS position FROM asked a JOIN placed p ON p.basket_id = a.basket_id WHERE NOT a.nowhere AND p.r > a.skip AND p.r <= a.skip + a.wanted
UNION ALL
SELECT a.basket_id, s.id, NULL, CAST(s.r - a.skip AS INTEGER) FROM asked a JOIN shops s ON s.r > a.skip AND s.r <= a.skip + a.wanted WHERE a.nowhere""")
def _by_request(t: Tables) -> DataFrame:
    """Cap and offset of each request; some requests have no position."""
    nowhere = F.col("basket_id") % 7 == 0
    origins = t.basket_origins.select(
        "basket_id", *(F.when(~nowhere, F.col(c)).alias(c) for c in ("lat", "lon")),
        (F.col("basket_id") % 5).alias("wanted"), (F.col("basket_id") % 3).alias("skip"),
    )
    near = S.nearest_stores(origins, t.stores, RADIUS_KM, "basket_id")
    return near.select("basket_id", "store_id", F.round("distance_km", 6).alias("distance_km"), "position")


@query("jn06_bounding_box", f"""
SELECT s.id, round({DISTANCE}, 2) AS distance_km FROM stores s CROSS JOIN (SELECT 58.4E0 AS lat, 24.9E0 AS lon) o
WHERE s.lat IS NOT NULL AND s.lat BETWEEN o.lat - 30.0/111 AND o.lat + 30.0/111
  AND s.lon BETWEEN o.lon - 30.0/(111*cos(radians(o.lat))) AND o.lon + 30.0/(111*cos(radians(o.lat)))
  AND {DISTANCE} <= 30.0""")
def _box(t: Tables) -> DataFrame:
    return S.within_box(t.stores, 58.4, 24.9, 30.0).select("id", "distance_km")


@query("jn07_nearby_chains", f"""
WITH {NEAR} SELECT basket_id, CASE WHEN chain = 'america' THEN 'asia' ELSE chain END AS chain, round(min(distance_km), 2) AS min_distance_km
FROM near GROUP BY 1, 2""")
def _nearby_chains(t: Tables) -> DataFrame:
    return S.chains_within(t.basket_origins, t.stores, RADIUS_KM, "basket_id", {"america": "asia"})


@query("jn19_build_price_source_map", """
SELECT p.id AS store_id, o.src AS source_store_id
FROM stores p JOIN (SELECT chain, min(id) AS src FROM stores WHERE is_online GROUP BY chain) o ON o.chain = p.chain
WHERE NOT p.is_online AND p.id NOT IN (SELECT store_id FROM store_price_source)""")
def _build_map(t: Tables) -> DataFrame:
    return S.build_price_source_map(t.stores, t.store_price_source)


@query("pf14_physical_stores", "SELECT id, chain FROM stores WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT is_online")
def _physical(t: Tables) -> DataFrame:
    return S.physical_stores(t.stores).select("id", "chain")


@query("pf15_stores_missing_geo", "SELECT id, chain FROM stores WHERE coalesce(lat, 0) = 0 OR coalesce(lon, 0) = 0")
def _missing_geo(t: Tables) -> DataFrame:
    return S.stores_missing_geo(t.stores).select("id", "chain")


@query("ag07_basket_pricing", f"""
WITH {PRICED} SELECT basket_id, store_id, lines_found, required_lines, total_price, coalesce(not_found, '') AS not_found FROM results""")
def _pricing(t: Tables) -> DataFrame:
    return results(t, missing=True).select(
        "basket_id", "store_id", "lines_found", "required_lines", "total_price", F.array_join("not_found", ",").alias("not_found")
    )


RANK = """ORDER BY CASE WHEN total_price IS NOT NULL AND lines_found = required_lines THEN 0 ELSE 1 END, lines_found DESC,
          total_price ASC NULLS LAST, distance_km ASC NULLS LAST, store_id"""


@query("sl01_basket_ranking", f"""
WITH {PRICED} SELECT basket_id, store_id, total_price, row_number() OVER (PARTITION BY basket_id {RANK}) AS rank FROM results""")
def _ranking(t: Tables) -> DataFrame:
    ranked, _ = B.rank_baskets(results(t, "rank"))
    return ranked.select("basket_id", "store_id", "total_price", F.col("rank").cast("long").alias("rank"))


@query("cheapest_store_for_every_basket", f"""
WITH {PRICED} SELECT basket_id, store_id, chain, total_price FROM (
  SELECT *, row_number() OVER (PARTITION BY basket_id {RANK}) AS r FROM results WHERE total_price IS NOT NULL) x WHERE r = 1""")
def winners(t: Tables) -> DataFrame:
    _, best = B.rank_baskets(results(t, "winner"))
    return best.select("basket_id", "store_id", "chain", "total_price")


CHAIN_TOTALS = f"""
{PRICED}, chain_best AS (
  SELECT basket_id, chain, total_price AS total, store_id FROM (
    SELECT *, row_number() OVER (PARTITION BY basket_id, chain ORDER BY total_price, store_id) AS r
    FROM results WHERE total_price IS NOT NULL AND lines_found = required_lines) x WHERE r = 1)
"""


@query("ag08_chain_totals", f"WITH {CHAIN_TOTALS} SELECT basket_id, chain, total, store_id FROM chain_best")
def _chain_totals(t: Tables) -> DataFrame:
    return B.chain_totals(results(t, "chain"))


COMPARES = f"""
{CHAIN_TOTALS}, compares AS (
  SELECT basket_id, CAST(count(*) AS BIGINT) AS chains, min(total) AS cheapest_total, arg_min(chain, total * 100000 + ascii(chain) * 256 + ascii(substr(chain, 2, 1))) AS cheapest_chain
  FROM chain_best GROUP BY basket_id HAVING count(*) >= 2)
"""


@query("ag08_basket_compare_summary", f"WITH {COMPARES} SELECT basket_id, chains, cheapest_total, cheapest_chain FROM compares")
def _compares(t: Tables) -> DataFrame:
    return B.compare_summary(results(t, "chain")).select("basket_id", "chains", "cheapest_total", "cheapest_chain")


@query("sl08_saved_winner", f"""
WITH {PRICED}, wanted AS (SELECT o_orderkey AS basket_id, o_orderkey % 40 AS want FROM orders)
SELECT basket_id, store_id AS winner_store_id, CAST(least(greatest(coalesce(total_price, 0), 0), 999999) AS BIGINT) AS winner_total FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.basket_id ORDER BY CASE WHEN r.store_id = w.want THEN 0 ELSE 1 END,
         total_price ASC NULLS LAST, store_id) AS n
  FROM results r JOIN wanted w ON w.basket_id = r.basket_id) x WHERE n = 1""")
def _saved(t: Tables) -> DataFrame:
    wanted = t.orders.select(F.col("o_orderkey").alias("basket_id"), (F.col("o_orderkey") % 40).alias("store_id"))
    return B.saved_winner(results(t, "saved", wanted), wanted, 999999)


@query("me16_basket_snapshots", f"""
WITH {PRICED}, best AS (
  SELECT basket_id, store_id, total_price FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY total_price ASC NULLS LAST, store_id) AS n FROM results) x WHERE n = 1)
SELECT b.basket_id, b.store_id, CAST(count(*) AS BIGINT) AS items, CAST(sum(l.price * l.quantity) AS BIGINT) AS item_total,
       (SELECT CAST(count(*) AS BIGINT) FROM results r WHERE r.basket_id = b.basket_id) AS stores_listed
FROM best b JOIN lines l ON l.basket_id = b.basket_id AND l.store_id = b.store_id GROUP BY b.basket_id, b.store_id""")
def _snapshots(t: Tables) -> DataFrame:
    lines = t.baskets.select("basket_id", "product_id", "quantity")
    goods, found = P.source_offers(latest(t)), results(t, "list")
    # the winners come from sums of their own, else all lists would be made twice
    best = B.saved_winner(results(t, "saved"), lines.select("basket_id", F.lit(None).cast("bigint").alias("store_id")).distinct())
    winners = S.within_pairs(best.select("basket_id", F.col("winner_store_id").alias("store_id")), t.basket_origins, t.stores, RADIUS_KM, "basket_id")
    priced = B.price_lines(lines, winners, goods, t.product_group_members, sources(t))
    headers, items = B.snapshot_baskets(priced, found, best)
    per_basket = items.groupBy("basket_id", "store_id").agg(F.count("*").alias("items"), F.sum("line_total").alias("item_total"))
    return per_basket.join(headers.select("basket_id", F.size("stores").cast("long").alias("stores_listed")), "basket_id")


@query("ag11_group_chain_rollup", f"""
SELECT coalesce(CAST(m.group_id AS VARCHAR), concat('u_', p.product_id)) AS dedup_key,
       string_agg(DISTINCT s.chain, ',' ORDER BY s.chain) AS chains,
       min(CASE WHEN p.promo_price <> 0 THEN p.promo_price ELSE p.price END) AS min_price
FROM prices p JOIN stores s ON s.id = p.store_id LEFT JOIN product_group_members m ON m.product_id = p.product_id
WHERE p.price > 0 AND p.collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 365 DAY GROUP BY 1""")
def _rollup(t: Tables) -> DataFrame:
    rows = P.group_chains(t.prices, t.stores, t.product_group_members, PRICE_AS_OF, 365)
    return rows.withColumn("chains", F.array_join("chains", ","))


@query("ag12_group_chain_price", """
SELECT m.group_id, s.chain, min(p.price) AS price FROM prices p JOIN stores s ON s.id = p.store_id
JOIN product_group_members m ON m.product_id = p.product_id GROUP BY 1, 2""")
def _group_chain_price(t: Tables) -> DataFrame:
    return P.group_chain_price(t.prices, t.stores, t.product_group_members)


@query("ag13_dedupe_prices", f"WITH {LATEST} SELECT product_id, store_id, price, promo_price FROM latest")
def _dedupe(t: Tables) -> DataFrame:
    return P.dedupe_prices(t.prices, "price_id").select("product_id", "store_id", "price", "promo_price")


@query("wn02_dedupe_rank", """
SELECT CAST(rn AS BIGINT) AS rn, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT row_number() OVER (PARTITION BY product_id, store_id ORDER BY collected_at DESC NULLS LAST, price_id) AS rn FROM prices) x
WHERE rn <= 3 GROUP BY rn""")
def _rank_counts(t: Tables) -> DataFrame:
    from cartwise.common import top_n

    kept = top_n(t.prices, ["product_id", "store_id"], 3, F.col("collected_at").desc_nulls_last(), F.col("price_id"), rank="rn")
    return kept.groupBy(F.col("rn").cast("long").alias("rn")).agg(F.count("*").alias("n"))


MATRIX = f"""
matrix AS (
  SELECT m.group_id, {", ".join(f"min(CASE WHEN s.chain = '{c}' THEN e END) AS c{i}" for i, c in enumerate(CHAINS))}
  FROM (SELECT *, CASE WHEN promo_price <> 0 THEN promo_price ELSE price END AS e FROM prices) p
  JOIN stores s ON s.id = p.store_id JOIN product_group_members m ON m.product_id = p.product_id
  WHERE p.price > 0 AND p.collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 30 DAY GROUP BY m.group_id)
"""
_CELLS = ", ".join(f"c{i}" for i in range(5))


@query("ag14_price_matrix", f"""
WITH {MATRIX} SELECT group_id, {_CELLS}, least({_CELLS}) AS min_price, greatest({_CELLS}) AS max_price,
  greatest({_CELLS}) - least({_CELLS}) AS spread FROM matrix""")
def _matrix(t: Tables) -> DataFrame:
    wide = P.price_matrix(t.prices, t.stores, t.product_group_members, t.product_groups, CHAINS, PRICE_AS_OF, 30)
    cells = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(CHAINS)]
    return wide.select("group_id", *cells, "min_price", "max_price", "spread")


@query("ag15_spread_summary", f"""
WITH {MATRIX}, spreads AS (
  SELECT greatest({_CELLS}) - least({_CELLS}) AS spread, {" + ".join(f"(CASE WHEN c{i} IS NULL THEN 0 ELSE 1 END)" for i in range(5))} AS k FROM matrix)
SELECT CAST(count(*) AS BIGINT) AS tracked, round(avg(CASE WHEN k >= 2 THEN spread END), 6) AS avg_spread, max(CASE WHEN k >= 2 THEN spread END) AS max_spread FROM spreads""")
def _spread(t: Tables) -> DataFrame:
    wide = P.price_matrix(t.prices, t.stores, t.product_group_members, t.product_groups, CHAINS, PRICE_AS_OF, 30)
    return P.spread_summary(wide, CHAINS).withColumn("avg_spread", F.round("avg_spread", 6))


@query("ag43_min_edge_price", "SELECT product_id, min(price) AS price FROM prices WHERE price > 0 GROUP BY product_id")
def _edges(t: Tables) -> DataFrame:
    return P.min_edge_price(t.prices, "product_id")


@query("pf02_fresh_prices", f"""
SELECT product_id, store_id, CASE WHEN promo_price <> 0 THEN promo_price ELSE price END AS price
FROM prices WHERE collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 14 DAY AND price > 0""")
def _fresh(t: Tables) -> DataFrame:
    from cartwise.common import fresh

    return fresh(t.prices, PRICE_AS_OF, 14).filter("price > 0").select("product_id", "store_id", P.effective_price().alias("price"))


CURRENT = f"""
{LATEST}, base AS (SELECT product_id, store_id, price, collected_at, CASE WHEN product_id % 3 = 0 THEN 'physical' ELSE 'feed' END AS source FROM latest)
"""


@query("me07_mirror_prices", f"""
WITH {CURRENT}, copies AS (
  SELECT product_id, store_id, price, source FROM (
    SELECT l.product_id, d.id AS store_id, l.price, concat('mirror:', d.chain, ':online') AS source,
           row_number() OVER (PARTITION BY l.product_id, d.id ORDER BY l.collected_at DESC NULLS LAST, l.price) AS r
    FROM latest l JOIN stores o ON o.id = l.store_id AND o.is_online JOIN stores d ON d.chain = o.chain AND NOT d.is_online) x WHERE r = 1)
SELECT coalesce(b.product_id, c.product_id) AS product_id, coalesce(b.store_id, c.store_id) AS store_id,
       CASE WHEN c.product_id IS NULL OR b.source = 'physical' THEN b.price ELSE c.price END AS price,
       CASE WHEN c.product_id IS NULL OR b.source = 'physical' THEN b.source ELSE c.source END AS source
FROM base b FULL OUTER JOIN copies c ON c.product_id = b.product_id AND c.store_id = b.store_id""")
def _mirror(t: Tables) -> DataFrame:
    rows = latest(t)
    base = rows.select(
        "product_id", "store_id", "price", "collected_at",
        F.when(F.col("product_id") % 3 == 0, F.lit("physical")).otherwise(F.lit("feed")).alias("source"),
    )
    return P.mirror_prices(base, rows, t.stores).select("product_id", "store_id", "price", "source")
