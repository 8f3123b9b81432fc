"""Queries of the substitution engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.common import settled
from cartwise.functions import traits, vocab
from cartwise.operators import substitution as X
from cartwise.plans.pricing import CHAINS, NEAR, near
from cartwise.plans.registry import query
from cartwise.sources.adapters import Tables

_CHAIN_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS chain" for c in CHAINS)

GAPS = f"""
priced AS (SELECT DISTINCT m.group_id, s.chain FROM shelf_prices p JOIN stores s ON s.id = p.store_id
           JOIN shelf_members m ON m.product_id = p.product_id WHERE p.price > 0),
gaps AS (SELECT g.id AS group_id, c.chain FROM shelf_groups g CROSS JOIN ({_CHAIN_ROWS}) c
         WHERE NOT EXISTS (SELECT 1 FROM priced x WHERE x.group_id = g.id AND x.chain = c.chain))
"""

SAMPLE = """
sample AS (SELECT * FROM (
  SELECT m.group_id, p.*, row_number() OVER (PARTITION BY m.group_id
    ORDER BY CASE WHEN p.net_qty > 0 AND p.net_unit IS NOT NULL THEN 0 ELSE 1 END, p.id) AS rn
  FROM shelf_members m JOIN shelf_products p ON p.id = m.product_id) z WHERE rn = 1)
"""

_LIMITS = " UNION ALL ".join(
    f"SELECT '{code}' AS sub_code, {a} AS auto_pct, {s} AS sug_pct" for code, (a, s) in vocab.QUANTITY_LIMITS.items()
)

_PROFILE = """
  CASE net_unit WHEN 'g' THEN 'g' WHEN 'ml' THEN 'ml' END AS base_unit,
  CASE WHEN net_unit IN ('g', 'ml') THEN net_qty * pack_count END AS base_qty, pack_count > 1 AS multi,
  CASE sub_code
    WHEN 'dairy_milk' THEN CASE WHEN txt LIKE '%maasika%' OR txt LIKE '%banaani%' THEN 'flavored' ELSE 'plain' END
    WHEN 'dairy_yogurt_kefir' THEN CASE WHEN txt LIKE '%maasika%' OR txt LIKE '%banaani%' THEN 'flavored' ELSE 'plain' END
    WHEN 'cheese_regular' THEN CASE WHEN txt LIKE '%gouda%' THEN 'gouda' WHEN txt LIKE '%mozzarella%' THEN 'mozzarella' END END AS h1,
  CASE sub_code
    WHEN 'dairy_milk' THEN CASE WHEN txt LIKE '%2,5\\%%' ESCAPE '\\' THEN '2.5' WHEN txt LIKE '%3,5\\%%' ESCAPE '\\' THEN '3.5' WHEN txt LIKE '%10\\%%' ESCAPE '\\' THEN '10.0' WHEN txt LIKE '%20\\%%' ESCAPE '\\' THEN '20.0' END
    WHEN 'dairy_yogurt_kefir' THEN CASE WHEN txt LIKE '%2,5\\%%' ESCAPE '\\' OR txt LIKE '%3,5\\%%' ESCAPE '\\' THEN 'standard' WHEN txt LIKE '%0\\%%' ESCAPE '\\' THEN 'greek' END
    WHEN 'cheese_regular' THEN CASE WHEN txt LIKE '%viil%' THEN 'sliced' ELSE 'block' END END AS h2,
  CASE sub_code WHEN 'dairy_yogurt_kefir' THEN CASE WHEN txt LIKE '%kreeka%' THEN 'greek' ELSE 'regular' END END AS h3,
  CASE WHEN txt LIKE '%laktoosivaba%' THEN 1 ELSE 0 END AS lactose, CASE WHEN txt LIKE '%gluteenivaba%' THEN 1 ELSE 0 END AS gluten,
  CASE WHEN txt LIKE '%vegan%' THEN 1 ELSE 0 END AS plant,
  CASE WHEN sub_code IN ('dairy_yogurt_kefir', 'tea') THEN CASE WHEN txt LIKE '%metsmaasika%' THEN 'wild' WHEN txt LIKE '%maasika%' THEN 'straw' WHEN txt LIKE '%banaani%' THEN 'banana' ELSE '' END
       WHEN sub_code = 'cheese_regular' THEN CASE WHEN txt LIKE '%viski%' THEN 'whisky' WHEN txt LIKE '%light%' THEN 'light' ELSE '' END
       WHEN sub_code = 'oils_olive' THEN CASE WHEN txt LIKE '%veise%' THEN 'beef' WHEN txt LIKE '%ekstra neitsi%' THEN 'extra' WHEN txt LIKE '%light%' THEN 'light' ELSE '' END
       ELSE '' END AS tags
"""

PAIRS = f"""
{GAPS}, {SAMPLE}, limits AS ({_LIMITS}),
originals AS (SELECT *, {_PROFILE} FROM (
  SELECT x.group_id, x.chain, g.sub_code, s.net_qty, s.net_unit, s.pack_count, lower(concat(g.canonical_name, ' ', s.name, ' ', g.brand)) AS txt
  FROM gaps x JOIN shelf_groups g ON g.id = x.group_id LEFT JOIN sample s ON s.group_id = x.group_id) z),
asked AS (SELECT * FROM originals WHERE coalesce(net_qty, 0) <> 0 AND coalesce(net_unit, '') <> ''),
carried AS (SELECT DISTINCT m.group_id, s.chain, p.product_id FROM shelf_prices p JOIN stores s ON s.id = p.store_id
            JOIN shelf_members m ON m.product_id = p.product_id WHERE p.price > 0),
units AS (SELECT DISTINCT net_unit AS want_unit FROM asked),
pool AS (SELECT *, {_PROFILE} FROM (
  SELECT u.want_unit, c.group_id AS c_id, c.chain, g.sub_code, p.net_qty, p.net_unit, p.pack_count,
         lower(concat(g.canonical_name, ' ', p.name, ' ', g.brand)) AS txt,
         row_number() OVER (PARTITION BY u.want_unit, c.group_id, c.chain ORDER BY CASE WHEN p.net_unit = u.want_unit THEN 0 ELSE 1 END,
           CASE WHEN p.net_qty > 0 THEN 0 ELSE 1 END, p.id) AS rn
  FROM carried c JOIN shelf_products p ON p.id = c.product_id JOIN shelf_groups g ON g.id = c.group_id CROSS JOIN units u) z WHERE rn = 1),
pairs AS (
  SELECT o.group_id, o.chain, o.sub_code, c.c_id, l.auto_pct, o.base_unit AS o_unit, c.base_unit AS c_unit, abs(c.base_qty - o.base_qty) AS gap,
    CASE WHEN o.base_unit IS NULL OR c.base_unit IS NULL THEN 'unknown' WHEN o.base_unit <> c.base_unit THEN 'incompatible'
         WHEN l.auto_pct IS NULL THEN 'unknown'
         WHEN abs(c.base_qty - o.base_qty) * 100 <= o.base_qty * l.auto_pct THEN CASE WHEN o.multi <> c.multi THEN 'suggested' ELSE 'auto' END
         WHEN abs(c.base_qty - o.base_qty) * 100 <= o.base_qty * l.sug_pct THEN 'suggested' ELSE 'incompatible' END AS tier,
    c.net_qty IS NULL OR c.net_unit IS NULL AS no_quantity, o.tags <> c.tags OR o.sub_code = 'tea' AS lower_it,
    o.lactose <= c.lactose AND o.gluten <= c.gluten AND o.plant = c.plant
      AND (o.h1 IS NULL OR coalesce(c.h1, '') = o.h1)
      AND ((o.sub_code = 'dairy_milk' AND o.h1 = 'flavored') OR o.h2 IS NULL OR coalesce(c.h2, '') = o.h2)
      AND (o.h3 IS NULL OR coalesce(c.h3, '') = o.h3) AS traits
  FROM asked o JOIN pool c ON c.want_unit = o.net_unit AND c.sub_code = o.sub_code AND c.chain = o.chain
  LEFT JOIN limits l ON l.sub_code = o.sub_code),
judged AS (SELECT *, CASE WHEN tier = 'auto' AND lower_it THEN 'suggested' ELSE tier END AS final FROM pairs),
usable AS (SELECT *, row_number() OVER (PARTITION BY group_id, chain ORDER BY CASE WHEN final = 'auto' THEN 0 ELSE 1 END, gap, c_id) AS position
           FROM judged WHERE tier IN ('auto', 'suggested') AND traits AND (sub_code <> 'baby_other' OR final = 'auto'))
"""


DECISIONS = """
tally AS (SELECT group_id, chain, count(*) AS n, count(*) FILTER (WHERE tier IN ('auto', 'suggested')) AS fitting FROM pairs GROUP BY 1, 2),
kept AS (SELECT group_id, chain, count(*) AS eligible, max(CASE WHEN position = 1 THEN c_id END) AS pick, max(CASE WHEN position = 1 THEN final END) AS pick_tier FROM usable GROUP BY 1, 2),
live AS (SELECT m.group_id, s.chain, min(p.price) AS price FROM shelf_prices p JOIN stores s ON s.id = p.store_id JOIN shelf_members m ON m.product_id = p.product_id GROUP BY 1, 2)
"""


def _requests(t: Tables) -> DataFrame:
    carried = X.carried_products(t.shelf_prices, t.stores, t.shelf_members)
    return X.gaps(t.shelf_groups, CHAINS, carried)


def _decided(t: Tables) -> tuple[DataFrame, DataFrame]:
    return X.decide(_requests(t), t.shelf_groups, t.shelf_members, t.shelf_products, t.shelf_prices, t.stores)


@query("sb01_gaps", f"WITH {GAPS} SELECT group_id, chain FROM gaps")
def _gaps(t: Tables) -> DataFrame:
    return _requests(t)


@query("sb02_group_sample", f"WITH {SAMPLE} SELECT group_id, id, net_qty, net_unit FROM sample")
def _sample(t: Tables) -> DataFrame:
    return X.group_sample(t.shelf_members, t.shelf_products).select("group_id", "id", "net_qty", "net_unit")


@query("sb03_candidate_pool", f"""
WITH {PAIRS} SELECT group_id, chain, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_id) AS BIGINT) AS id_sum FROM pairs GROUP BY 1, 2""")
def _pool(t: Tables) -> DataFrame:
    carried = X.carried_products(t.shelf_prices, t.stores, t.shelf_members)
    _, profiled = X.number_shapes(X.profiles(t.shelf_groups, t.shelf_members, t.shelf_products))
    asked = X.originals(_requests(t), profiled).filter("known")
    pool = X.candidates(asked, carried, profiled).groupBy(*X.KEY).agg(F.count("*").alias("n"), F.sum("group_id").alias("id_sum"))
    return asked.join(pool, X.KEY).select("group_id", "chain", "n", "id_sum")


@query("sb17_capped_pool", f"""
WITH {PAIRS} SELECT group_id, chain, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_id) AS BIGINT) AS id_sum
FROM (SELECT *, row_number() OVER (PARTITION BY group_id, chain ORDER BY c_id) AS place FROM pairs) x WHERE place <= 5 GROUP BY 1, 2""")
def _capped_pool(t: Tables) -> DataFrame:
    """The pool with its cap: of each pool the lowest group ids."""
    carried = X.carried_products(t.shelf_prices, t.stores, t.shelf_members)
    _, profiled = X.number_shapes(X.profiles(t.shelf_groups, t.shelf_members, t.shelf_products))
    asked = X.originals(_requests(t), profiled).filter("known")
    pool = X.candidates(asked, carried, profiled, pool_limit=5).groupBy(*X.KEY).agg(F.count("*").alias("n"), F.sum("group_id").alias("id_sum"))
    return asked.join(pool, X.KEY).select("group_id", "chain", "n", "id_sum")


@query("sb04_quantity_tiers", f"""
WITH {PAIRS} SELECT group_id, chain, CAST(count(*) FILTER (WHERE tier = 'auto') AS BIGINT) AS n_auto, CAST(count(*) FILTER (WHERE tier = 'suggested') AS BIGINT) AS n_suggested,
  CAST(count(*) FILTER (WHERE tier = 'incompatible') AS BIGINT) AS n_incompatible, CAST(count(*) FILTER (WHERE tier = 'unknown') AS BIGINT) AS n_unknown
FROM pairs GROUP BY 1, 2""")
def _tiers(t: Tables) -> DataFrame:
    decided, _ = _decided(t)
    return decided.filter("sql_candidate_count > 0").select(
        "group_id", "chain", F.col("quantity_auto_count").alias("n_auto"), F.col("quantity_suggested_count").alias("n_suggested"),
        F.col("quantity_incompatible_count").alias("n_incompatible"), F.col("quantity_unknown_count").alias("n_unknown"),
    )


@query("sb05_reject_reasons", f"""
WITH {PAIRS} SELECT group_id, chain,
  CAST(count(*) FILTER (WHERE tier = 'unknown' AND auto_pct IS NULL) AS BIGINT) AS missing_rule,
  CAST(count(*) FILTER (WHERE tier = 'unknown' AND auto_pct IS NOT NULL AND no_quantity) AS BIGINT) AS missing_candidate_quantity,
  CAST(count(*) FILTER (WHERE tier = 'incompatible' AND o_unit <> c_unit) AS BIGINT) AS unit_mismatch,
  CAST(count(*) FILTER (WHERE tier = 'unknown' AND auto_pct IS NOT NULL AND NOT no_quantity) AS BIGINT) AS unknown_unit,
  CAST(count(*) FILTER (WHERE tier = 'incompatible' AND o_unit = c_unit) AS BIGINT) AS outside_allowed_range
FROM pairs GROUP BY 1, 2""")
def _reasons(t: Tables) -> DataFrame:
    decided, _ = _decided(t)
    return decided.filter("sql_candidate_count > 0").select("group_id", "chain", *X.REASONS)


@query("sl09_candidate_shortlist", f"WITH {PAIRS} SELECT group_id, chain, c_id AS candidate_id, final AS tier, CAST(position AS BIGINT) AS position FROM usable WHERE position <= 8")
def _shortlist(t: Tables) -> DataFrame:
    _, short = _decided(t)
    return short.select("group_id", "chain", "candidate_id", "tier", F.col("position").cast("long").alias("position"))


@query("sb13_substitution_decisions", f"""
WITH {PAIRS},
{DECISIONS}
SELECT o.group_id, o.chain, CASE WHEN NOT (coalesce(o.net_qty, 0) <> 0 AND coalesce(o.net_unit, '') <> '') THEN 'no_quantity_data' WHEN k.eligible IS NULL THEN 'no_eligible_candidates'
         WHEN k.pick_tier = 'auto' THEN 'auto_substitute' ELSE 'suggested_substitute' END AS decision_type,
  k.pick AS substitute_group_id, CAST(coalesce(t.n, 0) AS BIGINT) AS sql_candidate_count, CAST(coalesce(t.fitting, 0) AS BIGINT) AS quantity_eligible_count,
  CAST(coalesce(k.eligible, 0) AS BIGINT) AS trait_eligible_count, l.price
FROM originals o LEFT JOIN tally t ON t.group_id = o.group_id AND t.chain = o.chain LEFT JOIN kept k ON k.group_id = o.group_id AND k.chain = o.chain
LEFT JOIN live l ON l.group_id = k.pick AND l.chain = o.chain""")
def _decisions(t: Tables) -> DataFrame:
    decided, _ = _decided(t)
    return decided.select(
        "group_id", "chain", "decision_type", "substitute_group_id", "sql_candidate_count", "quantity_eligible_count", "trait_eligible_count", "price"
    )


@query("sb12_verdict_join", f"""
WITH {PAIRS}, verdicts AS (SELECT group_id, chain, max(CASE WHEN position = 2 THEN c_id END) AS pick, max(CASE WHEN position = 2 THEN final END) AS pick_tier FROM usable WHERE position <= 8 GROUP BY 1, 2)
SELECT group_id, chain, CASE WHEN pick IS NULL THEN 'semantic_rejected' WHEN pick_tier = 'auto' THEN 'auto_substitute' ELSE 'suggested_substitute' END AS decision_type,
  pick AS substitute_group_id FROM verdicts""")
def _verdicts(t: Tables) -> DataFrame:
    requests = _requests(t)
    _, short = _decided(t)
    second = short.filter("position = 2").select(
        "group_id", "chain", F.col("candidate_id").alias("selected_group_id"), F.lit(True).alias("semantic_match")
    )
    decided, _ = X.decide(requests, t.shelf_groups, t.shelf_members, t.shelf_products, t.shelf_prices, t.stores, settled(second))
    return decided.filter("trait_eligible_count > 0").select("group_id", "chain", "decision_type", "substitute_group_id")


@query("sb18_decision_report", f"""
WITH {PAIRS}, kept AS (SELECT DISTINCT group_id, chain, final FROM usable WHERE position = 1)
SELECT decision_type, CAST(count(*) AS BIGINT) AS cases FROM (
  SELECT CASE WHEN NOT (coalesce(o.net_qty, 0) <> 0 AND coalesce(o.net_unit, '') <> '') THEN 'no_quantity_data' WHEN k.final IS NULL THEN 'no_eligible_candidates'
         WHEN k.final = 'auto' THEN 'auto_substitute' ELSE 'suggested_substitute' END AS decision_type
  FROM originals o LEFT JOIN kept k ON k.group_id = o.group_id AND k.chain = o.chain) z GROUP BY 1""")
def _report(t: Tables) -> DataFrame:
    decided, _ = _decided(t)
    return X.decision_report(decided)


def _shelf_text(t: Tables) -> DataFrame:
    sample = X.group_sample(t.shelf_members, t.shelf_products).select("group_id", "name")
    groups = t.shelf_groups.withColumnRenamed("id", "group_id").join(sample, "group_id").withColumnRenamed("group_id", "id")
    return groups.select("id", "sub_code", traits.identity_text(F.col("canonical_name"), F.col("name"), F.col("brand")).alias("txt"))


_TEXT = f"""
{SAMPLE}, texts AS (SELECT g.id, g.sub_code, concat(g.canonical_name, ' ', s.name, ' ', g.brand) AS txt FROM shelf_groups g JOIN sample s ON s.group_id = g.id)
"""


@query("sb06_identity_text", f"WITH {_TEXT} SELECT id, txt FROM texts")
def _identity_text(t: Tables) -> DataFrame:
    return _shelf_text(t).select("id", "txt")


@query("sb07_required_traits", f"""
WITH {_TEXT} SELECT id, CASE WHEN lower(txt) LIKE '%laktoosivaba%' THEN 'lactose_free' WHEN lower(txt) LIKE '%gluteenivaba%' THEN 'gluten_free' ELSE '' END AS required,
  CASE WHEN lower(txt) LIKE '%vegan%' THEN 'plant_based' ELSE '' END AS identity FROM texts""")
def _required(t: Tables) -> DataFrame:
    return _shelf_text(t).select(
        "id", F.array_join(traits.required_traits(F.col("txt")), ",").alias("required"),
        F.array_join(traits.identity_traits(F.col("txt")), ",").alias("identity"),
    )


_FAT = """CASE WHEN l LIKE '%2,5%' THEN 'pct_2.5' WHEN l LIKE '%3,5%' THEN 'pct_3.5' WHEN l LIKE '% 10\\%%' ESCAPE '\\' THEN 'pct_10.0' WHEN l LIKE '% 20\\%%' ESCAPE '\\' THEN 'pct_20.0' ELSE '-' END"""
_CREAM = """CASE WHEN l LIKE '%2,5%' OR l LIKE '%3,5%' THEN 'standard' WHEN l LIKE '%0\\%%' ESCAPE '\\' THEN 'greek_high_fat' ELSE '-' END"""
_STATE = "CASE WHEN l LIKE '%maasika%' OR l LIKE '%banaani%' THEN 'flavored' ELSE 'plain' END"


@query("sb09_hard_checks", f"""
WITH {_TEXT}, low AS (SELECT sub_code, lower(txt) AS l FROM texts), hard AS (SELECT sub_code, CASE sub_code
  WHEN 'dairy_milk' THEN concat({_STATE}, ',', {_FAT}, repeat(',-', 11))
  WHEN 'dairy_yogurt_kefir' THEN concat({_STATE}, ',-,', {_CREAM}, ',', CASE WHEN l LIKE '%kreeka%' THEN 'greek' ELSE 'regular' END, repeat(',-', 9))
  WHEN 'cheese_regular' THEN concat('-', repeat(',-', 6), ',', CASE WHEN l LIKE '%gouda%' THEN 'gouda' WHEN l LIKE '%mozzarella%' THEN 'mozzarella' ELSE '-' END, ',', CASE WHEN l LIKE '%viil%' THEN 'sliced' ELSE 'block' END, repeat(',-', 4))
  ELSE concat('-', repeat(',-', 12)) END AS hard FROM low)
SELECT sub_code, hard, CAST(count(*) AS BIGINT) AS groups FROM hard GROUP BY 1, 2""")
def _hard(t: Tables) -> DataFrame:
    values = F.array_join(traits.hard_values(F.col("sub_code"), F.col("txt")), ",", "-").alias("hard")
    return _shelf_text(t).select("sub_code", values).groupBy("sub_code", "hard").agg(F.count("*").alias("groups"))


_BERRY = "CASE WHEN l LIKE '%metsmaasika%' THEN 'flavour_variant:wild_strawberry' WHEN l LIKE '%maasika%' THEN 'flavour_variant:strawberry' WHEN l LIKE '%banaani%' THEN 'flavour_variant:banana' ELSE '' END"


@query("sb10_downgrade_checks", f"""
WITH {_TEXT}, low AS (SELECT sub_code, lower(txt) AS l FROM texts), tagged AS (SELECT sub_code, CASE sub_code WHEN 'dairy_yogurt_kefir' THEN {_BERRY} WHEN 'tea' THEN {_BERRY}
  WHEN 'cheese_regular' THEN CASE WHEN l LIKE '%viski%' THEN 'cheese_modifier:whisky' WHEN l LIKE '%light%' THEN 'cheese_modifier:light' ELSE '' END
  WHEN 'oils_olive' THEN CASE WHEN l LIKE '%veise%' THEN 'flavour_profile:beef_flavour' WHEN l LIKE '%ekstra neitsi%' THEN 'oil_grade:extra_virgin' WHEN l LIKE '%light%' THEN 'oil_grade:light' ELSE '' END
  ELSE '' END AS tags FROM low)
SELECT sub_code, tags, CAST(count(*) AS BIGINT) AS groups FROM tagged GROUP BY 1, 2""")
def _downgrade(t: Tables) -> DataFrame:
    tags = F.array_join(traits.downgrade_tags(F.col("sub_code"), F.col("txt")), ",").alias("tags")
    return _shelf_text(t).select("sub_code", tags).groupBy("sub_code", "tags").agg(F.count("*").alias("groups"))


@query("sb15_reuse_decisions", f"""
WITH {GAPS}, cache AS (SELECT group_id, chain FROM gaps WHERE group_id % 4 <> 0 AND group_id % 3 <> 1)
SELECT CAST(count(*) AS BIGINT) AS requests, CAST((SELECT count(*) FROM cache) AS BIGINT) AS reused, CAST(count(*) - (SELECT count(*) FROM cache) AS BIGINT) AS to_compute FROM gaps""")
def _reuse(t: Tables) -> DataFrame:
    requests = _requests(t)
    version = F.when(F.col("group_id") % 4 == 0, vocab.RULES_VERSION - 1).otherwise(vocab.RULES_VERSION)
    expires = F.when(F.col("group_id") % 3 == 1, F.lit("2001-12-01 00:00:00")).otherwise(F.lit("2001-12-03 00:00:00")).cast("timestamp")
    cache = requests.select(
        F.col("group_id").alias("original_group_id"), "chain", version.alias("substitution_rules_version"), expires.alias("expires_at"),
        F.col("group_id").alias("substitute_group_id"), F.lit("auto_substitute").alias("decision_type"),
    )
    live = X.group_price(X.carried_prices(t.shelf_prices, t.stores, t.shelf_members))
    hits, rest = X.reuse_decisions(requests, cache, "2001-12-01 12:00:00", live)
    count = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    kinds = count(hits, "hit").unionByName(count(rest, "miss"))
    return kinds.agg(
        F.count("*").alias("requests"), F.count_if(F.col("kind") == "hit").alias("reused"), F.count_if(F.col("kind") == "miss").alias("to_compute")
    )


_WATCHED = ("dairy_milk", "dairy_yogurt_kefir", "cheese_regular")


@query("sb16_shadow_sample", f"""
WITH {PAIRS}, {DECISIONS}, {NEAR},
decided AS (SELECT o.group_id, o.chain, CASE WHEN NOT (coalesce(o.net_qty, 0) <> 0 AND coalesce(o.net_unit, '') <> '') THEN 'no_quantity_data' WHEN k.eligible IS NULL THEN 'no_eligible_candidates'
    WHEN k.pick_tier = 'auto' THEN 'auto_substitute' ELSE 'suggested_substitute' END AS decision_type, k.pick, l.price, coalesce(t.n, 0) AS n
  FROM originals o LEFT JOIN tally t ON t.group_id = o.group_id AND t.chain = o.chain LEFT JOIN kept k ON k.group_id = o.group_id AND k.chain = o.chain LEFT JOIN live l ON l.group_id = k.pick AND l.chain = o.chain),
reach AS (SELECT basket_id, lower(chain) AS chain, min(store_id) AS first_seen_store_id FROM near GROUP BY 1, 2),
missed AS (SELECT b.basket_id, m.group_id, g.sub_code, x.chain, min(b.product_id) AS position, min(r.first_seen_store_id) AS first_seen_store_id
  FROM baskets b JOIN shelf_members m ON m.product_id = b.product_id JOIN shelf_groups g ON g.id = m.group_id JOIN gaps x ON x.group_id = m.group_id JOIN reach r ON r.basket_id = b.basket_id AND r.chain = x.chain
  WHERE g.sub_code IN {_WATCHED} AND CAST(concat('0x', substr(md5(CAST(b.basket_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10000 < 5000 GROUP BY 1, 2, 3, 4),
taken AS (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY position, group_id, chain) AS r FROM missed)
SELECT s.basket_id AS compare_request_id, s.chain, s.first_seen_store_id, s.group_id AS original_group_id, d.pick AS substitute_group_id, s.sub_code, d.decision_type, d.price AS candidate_price, CAST(d.n AS BIGINT) AS pool
FROM taken s JOIN decided d ON d.group_id = s.group_id AND d.chain = s.chain WHERE s.r <= 2""")
def _shadow(t: Tables) -> DataFrame:
    """Events of sampled baskets: lines that chains near them don't carry."""
    requests = _requests(t)
    decided, _ = _decided(t)
    missing = X.missing_lines(t.baskets, t.shelf_members, t.shelf_groups, requests, near(t))
    events = X.shadow_events(X.shadow_sample(missing, list(_WATCHED), 0.5), decided)
    return events.withColumn("pool", F.get_json_object("trace", "$.sql_candidate_count").cast("long")).drop("trace", "rules_version")
