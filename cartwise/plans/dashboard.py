"""Queries of the partner dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators import demand as D
from cartwise.operators import prices as P
from cartwise.plans.pricing import CHAINS, COMPARES, MATRIX, RADIUS_KM, results
from cartwise.operators.baskets import compare_events, compare_summary
from cartwise.plans.registry import query
from cartwise.sources.adapters import EVENT_AS_OF, PRICE_AS_OF, Tables

DAYS = 7
CUR = "created_at >= DATE '2024-01-30' - INTERVAL 6 DAY AND created_at < DATE '2024-01-30' + INTERVAL 1 DAY"
PREV = "created_at >= DATE '2024-01-30' - INTERVAL 13 DAY AND created_at < DATE '2024-01-30' - INTERVAL 6 DAY"
_CHAIN_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS chain" for c in CHAINS)


def _n(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _totals_sql(keys: str = "") -> str:
    cols = []
    for name, span in (("cur", CUR), ("prev", PREV)):
        cols += [
            _n(f"count(*) FILTER (WHERE {span} AND event_type = 'basket_add')", f"{name}_adds"),
            _n(f"count(*) FILTER (WHERE {span} AND event_type = 'product_view')", f"{name}_views"),
            _n(f"count(*) FILTER (WHERE {span} AND event_type = 'basket_win')", f"{name}_wins"),
            _n(f"count(DISTINCT CASE WHEN {span} AND device_key <> '' THEN device_key END)", f"{name}_devices"),
            _n(f"count(DISTINCT CASE WHEN {span} THEN user_id END)", f"{name}_users"),
        ]
    head = keys + ", " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {head}{', '.join(cols)} FROM analytics_events WHERE ({CUR}) OR ({PREV}){group}"


@query("ag16_event_totals", _totals_sql())
def _totals(t: Tables) -> DataFrame:
    return D.event_totals(t.analytics_events, EVENT_AS_OF, DAYS)


@query("ag16_event_totals_by_chain", _totals_sql("chain"))
def _totals_by_chain(t: Tables) -> DataFrame:
    return D.event_totals(t.analytics_events, EVENT_AS_OF, DAYS, ["chain"])


@query("ag16_sketched_totals", f"""
SELECT chain, cur_adds, cur_views, cur_wins, prev_adds, prev_views, prev_wins, true AS cur_devices_near, true AS cur_users_near, true AS prev_devices_near, true AS prev_users_near
FROM ({_totals_sql("chain")}) x""")
def _sketched(t: Tables) -> DataFrame:
    """Totals from daily sketches, with whether each estimate lies within two
    percent of the exact count."""
    rows = D.sketched_totals(D.daily_sketches(t.analytics_events, ["chain"]), EVENT_AS_OF, DAYS, ["chain"])
    exact = D.event_totals(t.analytics_events, EVENT_AS_OF, DAYS, ["chain"]).select(
        F.col("chain").alias("_chain"), *(F.col(f"{p}_{c}").alias(f"_{p}_{c}") for p in ("cur", "prev") for c in ("devices", "users"))
    )
    near = [(F.abs(F.col(f"{p}_{c}") - F.col(f"_{p}_{c}")) <= 0.02 * F.col(f"_{p}_{c}")).alias(f"{p}_{c}_near") for p in ("cur", "prev") for c in ("devices", "users")]
    counts = [f"{p}_{c}" for p in ("cur", "prev") for c in ("adds", "views", "wins")]
    return rows.join(exact, F.col("chain").eqNullSafe(F.col("_chain"))).select("chain", *counts, *near)


@query("ag17_period_delta", f"""
WITH totals AS ({_totals_sql("product_id")})
SELECT product_id, CASE WHEN prev_adds = 0 AND cur_adds > 0 THEN 'new' WHEN prev_adds <> 0 THEN printf('%.1f', round_even(CAST(cur_adds - prev_adds AS DOUBLE) / prev_adds * 100, 1)) END AS delta FROM totals""")
def _delta(t: Tables) -> DataFrame:
    totals = D.event_totals(t.analytics_events, EVENT_AS_OF, DAYS, ["product_id"])
    return totals.select("product_id", D.period_delta(F.col("cur_adds"), F.col("prev_adds")).alias("delta"))


@query("ag18_rates", f"""
WITH totals AS ({_totals_sql("chain")}), sums AS (SELECT sum(cur_wins) AS w FROM totals)
SELECT chain, CASE WHEN cur_views > 0 THEN round_even(CAST(cur_adds AS DOUBLE) / cur_views * 100, 1) END AS add_rate,
  CASE WHEN w > 0 THEN round_even(CAST(cur_wins AS DOUBLE) / w * 100, 1) END AS win_rate FROM totals, sums""")
def _rates(t: Tables) -> DataFrame:
    totals = D.event_totals(t.analytics_events, EVENT_AS_OF, DAYS, ["chain"])
    wins = totals.agg(F.sum("cur_wins").alias("w"))
    return totals.join(F.broadcast(wins)).select(  # one row
        "chain", D.rate(F.col("cur_adds"), F.col("cur_views")).alias("add_rate"), D.rate(F.col("cur_wins"), F.col("w")).alias("win_rate")
    )


@query("ag19_privacy_suppression", f"""
WITH totals AS ({_totals_sql("product_id")})
SELECT product_id, CASE WHEN cur_devices >= 10 THEN cur_devices END AS devices FROM totals""")
def _suppressed(t: Tables) -> DataFrame:
    totals = D.event_totals(t.analytics_events, EVENT_AS_OF, DAYS, ["product_id"])
    return totals.select("product_id", D.suppress_small(F.col("cur_devices"), F.col("cur_devices")).alias("devices"))


@query("ag20_daily_series", """
SELECT CAST(d.day AS VARCHAR) AS day, CAST(count(*) FILTER (WHERE event_type = 'product_view') AS BIGINT) AS product_view, CAST(count(*) FILTER (WHERE event_type = 'basket_add') AS BIGINT) AS basket_add,
  CAST(count(*) FILTER (WHERE event_type = 'basket_win') AS BIGINT) AS basket_win
FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-03', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN analytics_events e ON CAST(e.created_at AS DATE) = d.day GROUP BY d.day""")
def _daily(t: Tables) -> DataFrame:
    return D.daily_series(t.analytics_events, "2024-02-01 00:00:00", 30).withColumn("day", F.col("day").cast("string"))


@query("ag20_active_days", """
SELECT CAST(count(DISTINCT CAST(created_at AS DATE)) AS BIGINT) AS active_days FROM analytics_events
WHERE created_at >= DATE '2024-01-03' AND created_at < DATE '2024-02-02' AND event_type IN ('basket_add', 'basket_win')""")
def _active(t: Tables) -> DataFrame:
    return D.active_days(D.daily_series(t.analytics_events, "2024-02-01 00:00:00", 30))


@query("ag21_top_products", f"""
SELECT x.product_id, x.chain, x.adds, p.name FROM (
  SELECT product_id, chain, CAST(count(*) AS BIGINT) AS adds FROM analytics_events WHERE event_type = 'basket_add' AND {CUR}
  GROUP BY 1, 2 ORDER BY adds DESC, product_id, chain LIMIT 10) x LEFT JOIN products p ON p.id = x.product_id""")
def _top(t: Tables) -> DataFrame:
    return D.top_products(t.analytics_events, t.products, EVENT_AS_OF, DAYS)


@query("ag22_event_summary", """
SELECT chain, event_type, CAST(count(*) AS BIGINT) AS count FROM analytics_events
WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 14 DAY GROUP BY 1, 2""")
def _summary(t: Tables) -> DataFrame:
    return D.event_summary(t.analytics_events, EVENT_AS_OF, 14)


@query("ag22_event_summary_of_chain", """
SELECT event_type, CAST(count(*) AS BIGINT) AS count FROM analytics_events
WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 14 DAY AND lower(chain) = 'europe' GROUP BY 1""")
def _summary_chain(t: Tables) -> DataFrame:
    return D.event_summary(t.analytics_events, EVENT_AS_OF, 14, "Europe")


def _labels(t: Tables) -> DataFrame:
    return t.product_categories.join(t.categories, "sub_id", "left").select("product_id", F.when(F.col("sub_id") != 7, F.col("main_label")).alias("label"))


LABELLED = """
labelled AS (SELECT pc.product_id, coalesce(CASE WHEN c.sub_id <> 7 THEN c.main_label END, 'Muu') AS category
             FROM product_categories pc LEFT JOIN categories c ON c.sub_id = pc.sub_id)
"""


@query("ag23_category_demand", f"""
WITH {LABELLED} SELECT category, CAST(count(*) AS BIGINT) AS cnt FROM analytics_events e JOIN labelled l ON l.product_id = e.product_id
WHERE event_type = 'basket_add' AND {CUR} GROUP BY 1 ORDER BY cnt DESC, category LIMIT 8""")
def _category_demand(t: Tables) -> DataFrame:
    return D.category_demand(D.category_counts(t.analytics_events, _labels(t), EVENT_AS_OF, DAYS))


@query("jn18_category_momentum", f"""
WITH {LABELLED}, c AS (SELECT category, count(*) AS cnt FROM analytics_events e JOIN labelled l ON l.product_id = e.product_id WHERE event_type = 'basket_add' AND {CUR} GROUP BY 1),
p AS (SELECT category, count(*) AS cnt FROM analytics_events e JOIN labelled l ON l.product_id = e.product_id WHERE event_type = 'basket_add' AND {PREV} GROUP BY 1)
SELECT coalesce(c.category, p.category) AS category, CAST(coalesce(c.cnt, 0) AS BIGINT) AS current_cnt, CAST(coalesce(p.cnt, 0) AS BIGINT) AS prev_cnt
FROM c FULL OUTER JOIN p ON p.category = c.category""")
def _category_momentum(t: Tables) -> DataFrame:
    counts = D.category_counts(t.analytics_events, _labels(t), EVENT_AS_OF, DAYS)
    side = lambda name: counts.filter(f"{name} > 0").select("category", F.col(name).alias("cnt"))
    return D.category_momentum(side("current_cnt"), side("prev_cnt"))


@query("ag24_product_momentum", f"""
WITH counts AS (SELECT product_id, count(*) FILTER (WHERE {CUR}) AS cur, count(*) FILTER (WHERE {PREV}) AS prev FROM analytics_events WHERE event_type = 'basket_add' GROUP BY 1),
rising AS (SELECT *, CASE WHEN prev >= 2 THEN round_even(CAST(cur - prev AS DOUBLE) / prev * 100, 1) END AS growth FROM counts WHERE cur >= 3)
SELECT product_id, CAST(cur AS BIGINT) AS current_cnt, CAST(prev AS BIGINT) AS prev_cnt, growth FROM rising WHERE prev = 0 OR growth > 0
ORDER BY cur DESC, CASE WHEN prev = 0 THEN 999 ELSE growth END DESC, product_id LIMIT 5""")
def _momentum(t: Tables) -> DataFrame:
    rows = D.momentum(D.product_momentum(t.analytics_events, EVENT_AS_OF, DAYS), "product_id")
    return rows.select("product_id", "current_cnt", "prev_cnt", "growth")


@query("ag25_low_conversion", f"""
SELECT product_id, views, adds FROM (SELECT product_id, CAST(count(*) FILTER (WHERE event_type = 'product_view') AS BIGINT) AS views, CAST(count(*) FILTER (WHERE event_type = 'basket_add') AS BIGINT) AS adds
  FROM analytics_events WHERE {CUR} GROUP BY 1) x WHERE views >= 5 ORDER BY CAST(adds AS DOUBLE) / views, product_id LIMIT 8""")
def _low(t: Tables) -> DataFrame:
    return D.low_conversion(t.analytics_events, EVENT_AS_OF, DAYS)


CARRIED = f"""
carried AS (SELECT DISTINCT m.group_id, s.chain FROM prices p JOIN stores s ON s.id = p.store_id JOIN product_group_members m ON m.product_id = p.product_id
            WHERE p.price > 0 AND p.collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 60 DAY)
"""
DEMAND = f"""
demand AS (SELECT m.group_id, count(*) FILTER (WHERE event_type = 'product_view') AS views, count(*) FILTER (WHERE event_type = 'basket_add') AS adds, count(*) AS demand
           FROM analytics_events e JOIN product_group_members m ON m.product_id = e.product_id WHERE event_type IN ('product_view', 'basket_add') AND {CUR} GROUP BY 1)
"""


def _carried(t: Tables) -> DataFrame:
    return D.carried_groups(t.prices, t.stores, t.product_group_members, PRICE_AS_OF, 60)


@query("ag26_chain_coverage", f"""
WITH {CARRIED} SELECT c.chain, CAST((SELECT count(*) FROM carried x WHERE x.chain = c.chain) AS BIGINT) AS covered, CAST((SELECT count(*) FROM product_groups) AS BIGINT) AS total_groups
FROM ({_CHAIN_ROWS}) c""")
def _coverage(t: Tables) -> DataFrame:
    return D.chain_coverage(_carried(t), t.product_groups, CHAINS)


@query("jn15_missing_assortment", f"""
WITH d AS (SELECT product_id, count(*) AS n FROM analytics_events WHERE event_type IN ('basket_add', 'product_view') AND {CUR} GROUP BY 1),
dp AS (SELECT d.product_id, d.n, p.name, coalesce(m.group_id, -d.product_id) AS grp FROM d JOIN products p ON p.id = d.product_id LEFT JOIN product_group_members m ON m.product_id = d.product_id),
live AS (SELECT DISTINCT p.product_id FROM prices p JOIN stores s ON s.id = p.store_id WHERE s.chain = 'asia' AND p.price > 0 AND p.collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 60 DAY)
SELECT grp, CAST(sum(n) AS BIGINT) AS demand_count, min_by(name, -n * 1000000 + product_id) AS name FROM dp
WHERE grp NOT IN (SELECT grp FROM dp WHERE product_id IN (SELECT product_id FROM live)) GROUP BY grp""")
def _missing(t: Tables) -> DataFrame:
    return D.missing_assortment(
        t.analytics_events, t.products, t.product_group_members, t.prices, t.stores, "Asia", EVENT_AS_OF, DAYS, PRICE_AS_OF, 60
    )


@query("jn16_opportunities", f"""
WITH {CARRIED}, {DEMAND} SELECT group_id, CAST(demand AS BIGINT) AS demand, chain FROM (
  SELECT d.group_id, d.demand, c.chain, row_number() OVER (PARTITION BY c.chain ORDER BY d.demand DESC, d.group_id) AS r
  FROM demand d CROSS JOIN ({_CHAIN_ROWS}) c WHERE NOT EXISTS (SELECT 1 FROM carried x WHERE x.group_id = d.group_id AND x.chain = c.chain)) z WHERE r <= 5""")
def _opportunities(t: Tables) -> DataFrame:
    demand = D.group_demand(t.analytics_events, t.product_group_members, EVENT_AS_OF, DAYS)
    return D.opportunities(demand, _carried(t), CHAINS)


@query("jn17_brand_scope", """
SELECT b.partner_id, g.id AS group_id, m.product_id
FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS partner_id, lower(p_brand) AS brand FROM part) b
JOIN product_groups g ON lower(g.brand) = b.brand JOIN product_group_members m ON m.group_id = g.id""")
def _brand_scope(t: Tables) -> DataFrame:
    partners = t.part.groupBy(F.col("p_size").cast("long").alias("partner_id")).agg(F.collect_set(F.upper("p_brand")).alias("brand_filter"))
    return D.brand_scope(partners, t.product_groups, t.product_group_members).select("partner_id", "group_id", "product_id")


@query("wn03_chain_ranking", f"""
WITH w AS (SELECT lower(chain) AS chain, count(*) AS wins FROM analytics_events WHERE event_type = 'basket_win' AND {CUR} GROUP BY 1),
r AS (SELECT c.chain, CAST(coalesce(w.wins, 0) AS BIGINT) AS wins FROM ({_CHAIN_ROWS}) c LEFT JOIN w ON w.chain = c.chain)
SELECT chain, wins, CAST(rank() OVER (ORDER BY wins DESC) AS BIGINT) AS position, count(*) OVER (PARTITION BY wins) > 1 AS tied,
  CASE WHEN chain = 'asia' THEN 'Asia' ELSE concat('Konkurent ', chr(CAST(64 + sum(CASE WHEN chain <> 'asia' THEN 1 ELSE 0 END) OVER (ORDER BY wins DESC, chain ROWS UNBOUNDED PRECEDING) AS INT))) END AS shown_as FROM r""")
def _ranking(t: Tables) -> DataFrame:
    return D.chain_ranking(t.analytics_events, EVENT_AS_OF, DAYS, CHAINS, "asia").withColumn("position", F.col("position").cast("long"))


@query("ag40_last_event", "SELECT chain, CAST(floor(epoch(max(created_at))) AS BIGINT) AS last_event FROM analytics_events GROUP BY 1")
def _last(t: Tables) -> DataFrame:
    return D.last_event(t.analytics_events, ["chain"]).select("chain", F.unix_seconds(F.col("last_event").cast("timestamp")).alias("last_event"))


@query("ag41_fill_rate", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(nullif(device_key, '')) AS BIGINT) AS filled FROM analytics_events")
def _fill(t: Tables) -> DataFrame:
    return D.fill_rate(t.analytics_events.withColumn("device_key", F.nullif("device_key", F.lit(""))), "device_key")


@query("ag37_attribute_chain", """
WITH best AS (SELECT product_id, store_id FROM (SELECT product_id, store_id, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS r FROM prices) x WHERE r = 1),
lows AS (SELECT b.product_id, s.chain FROM best b JOIN stores s ON s.id = b.store_id)
SELECT event_id, CASE WHEN e.event_type = 'basket_add' AND e.user_id % 4 = 0 THEN l.chain WHEN e.user_id % 4 = 0 THEN NULL ELSE lower(e.chain) END AS chain
FROM analytics_events e LEFT JOIN lows l ON l.product_id = e.product_id""")
def _attribute(t: Tables) -> DataFrame:
    events = t.analytics_events.withColumn("chain", F.when(F.col("user_id") % 4 != 0, F.col("chain")))
    return D.attribute_chain(events, t.prices, t.stores).select("event_id", "chain")


def _compare_log(t: Tables) -> DataFrame:
    return compare_events(compare_summary(results(t, "chain")), RADIUS_KM)


SENSITIVE = f"""
{COMPARES}, own AS (
  SELECT c.cheapest_chain AS winner, b.chain, b.total, c.cheapest_total,
         (SELECT min(r.total) FROM chain_best r WHERE r.basket_id = b.basket_id AND r.chain <> b.chain) AS rival
  FROM compares c JOIN chain_best b ON b.basket_id = c.basket_id),
gaps AS (SELECT chain, winner, chain = winner AS won, CASE WHEN chain = winner THEN rival - total ELSE total - cheapest_total END / 10000.0 AS gap FROM own)
"""


def _bucket(low: str, high: str, won: str, name: str) -> str:
    return _n(f"count(*) FILTER (WHERE {won} AND gap > {low} AND gap <= {high})", name)


@query("ag27_price_sensitivity", f"""
WITH {SENSITIVE} SELECT chain, CAST(count(*) AS BIGINT) AS compares, CAST(count(*) FILTER (WHERE won) AS BIGINT) AS wins,
  {_bucket('0', '0.5', 'NOT won', 'near_loss_050')}, {_bucket('0.5', '1', 'NOT won', 'near_loss_100')}, {_bucket('1', '2', 'NOT won', 'near_loss_200')},
  {_bucket('0', '0.5', 'won', 'near_win_050')}, {_bucket('0.5', '1', 'won', 'near_win_100')}, {_bucket('1', '2', 'won', 'near_win_200')}
FROM gaps GROUP BY chain HAVING count(*) >= 10 AND (SELECT count(*) FROM compares) >= 30""")
def _sensitivity(t: Tables) -> DataFrame:
    return D.price_sensitivity(_compare_log(t), CHAINS, unit=10000.0)


@query("ag27_narrow_losses", f"""
WITH {SENSITIVE} SELECT chain, winner, losses FROM (
  SELECT chain, winner, CAST(count(*) AS BIGINT) AS losses, row_number() OVER (PARTITION BY chain ORDER BY count(*) DESC, winner) AS r
  FROM gaps WHERE NOT won AND gap > 0 AND gap <= 1 GROUP BY 1, 2) x WHERE r <= 3""")
def _losses(t: Tables) -> DataFrame:
    return D.narrow_losses(_compare_log(t), CHAINS, unit=10000.0)


@query("ss06_compare_events", f"""
WITH {COMPARES} SELECT basket_id, 'basket_compare' AS event_type, cheapest_chain AS chain, CAST(cheapest_total AS BIGINT) AS cheapest_total, chains, {RADIUS_KM}::DOUBLE AS radius_km FROM compares""")
def _compare_events(t: Tables) -> DataFrame:
    field = lambda name, kind: F.get_json_object("payload", f"$.{name}").cast(kind).alias(name)
    chains = F.size(F.from_json(F.get_json_object("payload", "$.chain_totals"), "map<string,long>")).cast("long").alias("chains")
    return _compare_log(t).select("basket_id", "event_type", "chain", field("cheapest_total", "long"), chains, field("radius_km", "double"))


@query("ag39_latency_report", """
WITH ranked AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = round_even(0.5::DOUBLE * (n - 1), 0) THEN value END) AS p50, max(CASE WHEN i = round_even(0.9::DOUBLE * (n - 1), 0) THEN value END) AS p90,
  max(CASE WHEN i = round_even(0.95::DOUBLE * (n - 1), 0) THEN value END) AS p95, max(CASE WHEN i = round_even(0.99::DOUBLE * (n - 1), 0) THEN value END) AS p99
FROM ranked GROUP BY event_type""")
def _latency(t: Tables) -> DataFrame:
    return D.latency_report(t.events, ["event_type"], "value")


@query("sc09_period_export", f"""
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, event_type, e.chain, p.name AS product_name, CAST(count(*) AS BIGINT) AS count
FROM analytics_events e LEFT JOIN products p ON p.id = e.product_id WHERE {CUR} GROUP BY 1, 2, 3, 4""")
def _export(t: Tables) -> DataFrame:
    return D.export_events(t.analytics_events, t.products, EVENT_AS_OF, DAYS).withColumn("day", F.col("day").cast("string"))


_PRICE_CELLS = ", ".join(f"coalesce(replace(printf('%.2f', c{i} / 100.0::DOUBLE), '.', ','), '') AS price_{c.replace(' ', '_')}" for i, c in enumerate(CHAINS))
_LACKING = ", ".join(f"CASE WHEN c{i} IS NULL THEN '{c.capitalize()}' END" for i, c in enumerate(CHAINS))


@query("sc10_brand_export", f"""
WITH {MATRIX}, {DEMAND}
SELECT g.id AS group_id, g.canonical_name AS name, CAST(coalesce(d.views, 0) AS BIGINT) AS views, CAST(coalesce(d.adds, 0) AS BIGINT) AS adds,
  CASE WHEN coalesce(d.views, 0) > 0 THEN replace(concat(printf('%.1f', round_even(CAST(d.adds AS DOUBLE) / d.views * 100, 1)), '%'), '.', ',') ELSE '' END AS add_rate,
  {_PRICE_CELLS}, concat_ws(', ', {_LACKING}) AS missing_chains
FROM product_groups g LEFT JOIN demand d ON d.group_id = g.id LEFT JOIN matrix m ON m.group_id = g.id""")
def _brand_export(t: Tables) -> DataFrame:
    demand = D.group_demand(t.analytics_events, t.product_group_members, EVENT_AS_OF, DAYS)
    wide = P.price_matrix(t.prices, t.stores, t.product_group_members, t.product_groups, CHAINS, PRICE_AS_OF, 30)
    return D.export_brand(t.product_groups, demand, wide, CHAINS, cents=True)
