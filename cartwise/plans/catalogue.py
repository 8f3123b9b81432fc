"""Queries over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.common import dealt, spread
from cartwise.functions import codes, names, similarity
from cartwise.operators import catalog as C
from cartwise.operators import prices as P
from cartwise.operators import stores as S
from cartwise.operators import textsearch as X
from cartwise.operators.baskets import resolve_names
from cartwise.plans.registry import query
from cartwise.sources.adapters import PRICE_AS_OF, Tables

ROLLUP = f"""
rollup AS (SELECT coalesce(CAST(m.group_id AS VARCHAR), concat('u_', p.product_id)) AS dedup_key, string_agg(DISTINCT s.chain, ',' ORDER BY s.chain) AS chains,
  min(CASE WHEN p.promo_price <> 0 THEN p.promo_price ELSE p.price END) AS min_price
  FROM prices p JOIN stores s ON s.id = p.store_id LEFT JOIN product_group_members m ON m.product_id = p.product_id
  WHERE p.price > 0 AND p.collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 365 DAY GROUP BY 1)
"""

GROUPED = """
grouped AS (SELECT p.*, m.group_id, g.canonical_name, g.brand AS group_brand, g.sub_code AS group_sub_code,
  coalesce(CAST(m.group_id AS VARCHAR), concat('u_', p.id)) AS dedup_key,
  lower(concat_ws(' ', p.name, p.brand)) AS search_text, lower(concat_ws(' ', g.canonical_name, g.brand)) AS group_search_text
  FROM products p LEFT JOIN product_group_members m ON m.product_id = p.id LEFT JOIN product_groups g ON g.id = m.group_id)
"""

RANK = """CASE WHEN source_url LIKE '%prisma%' THEN 1 WHEN source_url LIKE '%selver%' THEN 2 WHEN source_url LIKE '%rimi%' THEN 3 WHEN source_url LIKE '%barbora%' OR source_url LIKE '%maxima%' THEN 4
  WHEN source_url LIKE '%ecoop%' OR (source_url LIKE '%coop%' AND source_url NOT LIKE '%wolt%') THEN 5 WHEN source_url LIKE '%wolt%' THEN 6 WHEN coalesce(source_url, '') = '' THEN 7 ELSE 8 END"""

FRESH_IDS = f"(SELECT product_id FROM prices WHERE collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 14 DAY)"


def _rollup(t: Tables) -> DataFrame:
    return P.group_chains(t.prices, t.stores, t.product_group_members, PRICE_AS_OF, 365)


def _grouped(t: Tables) -> DataFrame:
    rows = C.with_group(t.products, t.product_group_members, t.product_groups)
    return rows.withColumns({
        "search_text": C.search_text(F.col("name"), F.col("brand")), "group_search_text": C.search_text(F.col("canonical_name"), F.col("group_brand")),
    })


@query("pf03_products_with_fresh_price", f"SELECT id, name FROM products WHERE id IN {FRESH_IDS}")
def _with_fresh(t: Tables) -> DataFrame:
    return C.with_fresh_price(t.products, t.prices, PRICE_AS_OF).select("id", "name")


@query("pf04_effective_sub_code", f"WITH {GROUPED} SELECT id, coalesce(nullif(trim(group_sub_code), ''), nullif(trim(sub_code), '')) AS code, dedup_key FROM grouped")
def _codes(t: Tables) -> DataFrame:
    return _grouped(t).select("id", C.effective_sub_code().alias("code"), "dedup_key")


_DETAIL = """SELECT g.id, g.group_id, coalesce(nullif(trim(g.canonical_name), ''), g.name, '') AS name, trim(coalesce(g.group_brand, '')) AS brand, trim(coalesce(g.size_text, '')) AS size_text,
  lower(trim(coalesce(g.size_text, ''))) = 'kg' AS is_per_kg, g.sub_code, coalesce(r.chains, '') AS available_chains, r.min_price FROM grouped g LEFT JOIN rollup r ON r.dedup_key = g.dedup_key"""


@query("jn26_product_detail", f"WITH {ROLLUP}, {GROUPED} {_DETAIL}")
def _detail(t: Tables) -> DataFrame:
    rows = C.product_detail(t.products, t.product_group_members, t.product_groups, _rollup(t))
    return rows.withColumn("available_chains", F.array_join("available_chains", ","))


@query("sl05_browse_dedupe", f"""
WITH {GROUPED} SELECT dedup_key, id FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {RANK},
  CASE WHEN coalesce(image_url, '') <> '' THEN 0 ELSE 1 END, CASE WHEN coalesce(ean, '') <> '' THEN 0 ELSE 1 END, id) AS r FROM grouped) x WHERE r = 1""")
def _dedupe(t: Tables) -> DataFrame:
    return C.browse_dedupe(_grouped(t)).select("dedup_key", "id")


@query("pf08_browse_filters", f"""
WITH {GROUPED} SELECT id, name FROM grouped WHERE coalesce(nullif(trim(group_sub_code), ''), sub_code) = 'sub_economy' AND trim(group_brand) = 'Brand#1'""")
def _browse(t: Tables) -> DataFrame:
    return C.browse(_grouped(t), sub_code=" sub_economy ", main_code="ignored", brand="Brand#1").select("id", "name")


def _browse_sql(order: str, limit: int, offset: int) -> str:
    return f"""
WITH {ROLLUP}, {GROUPED}, base AS (SELECT g.*, r.min_price FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {RANK},
  CASE WHEN coalesce(image_url, '') <> '' THEN 0 ELSE 1 END, CASE WHEN coalesce(ean, '') <> '' THEN 0 ELSE 1 END, id) AS r FROM grouped) g
  LEFT JOIN rollup r ON r.dedup_key = g.dedup_key WHERE g.r = 1)
SELECT id, dedup_key, min_price FROM base ORDER BY {order}, coalesce(nullif(trim(canonical_name), ''), name, ''), id LIMIT {limit} OFFSET {offset}"""


@query("sl03_browse_by_price", _browse_sql("min_price ASC NULLS LAST", 40, 20))
def _by_price(t: Tables) -> DataFrame:
    rows = C.browse_dedupe(_grouped(t)).join(_rollup(t), "dedup_key", "left")
    return C.paginate(rows, C.browse_order("price_asc"), 40, 20).select("id", "dedup_key", "min_price")


@query("sl03_browse_by_price_desc", _browse_sql("min_price DESC NULLS LAST", 50, 0))
def _by_price_desc(t: Tables) -> DataFrame:
    rows = C.browse_dedupe(_grouped(t)).join(_rollup(t), "dedup_key", "left")
    return C.paginate(rows, C.browse_order("price_desc"), 50).select("id", "dedup_key", "min_price")


@query("sl04_pagination", "SELECT id, true AS has_more, CAST(70 AS BIGINT) AS next_offset FROM products ORDER BY name, id LIMIT 20 OFFSET 50")
def _page(t: Tables) -> DataFrame:
    page = C.paginate(t.products, [F.col("name").asc(), F.col("id").asc()], 20, 50)
    return page.select("id", "has_more", F.col("next_offset").cast("long").alias("next_offset"))


@query("pf07_token_search", f"""
WITH {GROUPED} SELECT id FROM grouped WHERE (search_text LIKE '%wid%' OR group_search_text LIKE '%wid%') AND (search_text LIKE '%red%' OR group_search_text LIKE '%red%')""")
def _search(t: Tables) -> DataFrame:
    return C.token_search(_grouped(t), "WID x red").select("id")


QUERIES_SQL = """
asked AS (SELECT DISTINCT c_custkey AS query_id, concat(substr(split_part(p_name, ' ', 2), 1, 4), ' ', split_part(p_name, ' ', 1)) AS q
          FROM customer JOIN part ON p_partkey = c_custkey)
"""


@query("pf07_token_search_many", f"""
WITH {QUERIES_SQL}, {GROUPED}, texts AS (SELECT id, concat(search_text, chr(10), coalesce(group_search_text, '')) AS txt FROM grouped)
SELECT a.query_id, CAST(count(*) AS BIGINT) AS hits, CAST(sum(x.id) AS BIGINT) AS id_sum FROM asked a JOIN texts x
  ON x.txt LIKE concat('%', split_part(a.q, ' ', 1), '%') AND x.txt LIKE concat('%', split_part(a.q, ' ', 2), '%') GROUP BY 1""")
def _search_many(t: Tables) -> DataFrame:
    name = F.split("p_name", " ")
    asked = t.customer.join(t.part, F.col("p_partkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("query_id"), F.concat_ws(" ", F.substring(F.get(name, F.lit(1)), 1, 4), F.get(name, F.lit(0))).alias("q")
    )
    # equal searches are answered and summed up once, so their hits are not listed for each of them
    once = asked.select(F.col("q").alias("query_id"), "q").distinct()
    hits = C.token_search_join(once, _grouped(t).select("id", "search_text", "group_search_text"))
    sums = hits.groupBy(F.col("query_id").alias("q")).agg(F.count("*").alias("hits"), F.sum("id").alias("id_sum"))
    return asked.join(sums, "q").groupBy("query_id").agg(F.sum("hits").alias("hits"), F.sum("id_sum").alias("id_sum"))


@query("sl02_relevance_rank", f"""
WITH {GROUPED}, hits AS (SELECT *, coalesce(nullif(trim(canonical_name), ''), name, '') AS shown FROM grouped WHERE search_text LIKE '%red%' OR group_search_text LIKE '%red%')
SELECT id, CAST(CASE WHEN lower(shown) = 'red widget' THEN 0 WHEN lower(shown) LIKE 'red widget%' THEN 1 WHEN lower(coalesce(group_brand, '')) = 'red widget' THEN 2 ELSE 3 END AS BIGINT) AS tier FROM hits""")
def _relevance(t: Tables) -> DataFrame:
    hits = C.token_search(_grouped(t), "red")
    return C.relevance_rank(hits, " Red  widget ").select("id", F.col("tier").cast("long").alias("tier"))


@query("sl07_category_of_name", f"""
WITH {GROUPED}, wanted AS (SELECT DISTINCT p_name AS product_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part),
cand AS (SELECT w.product_name, coalesce(nullif(trim(g.group_sub_code), ''), nullif(trim(g.sub_code), '')) AS sub_code,
  row_number() OVER (PARTITION BY w.product_name ORDER BY CASE WHEN lower(g.name) = lower(w.product_name) THEN 0 WHEN lower(g.canonical_name) = lower(w.product_name) THEN 1 ELSE 2 END, g.id) AS r
  FROM wanted w JOIN grouped g ON contains(lower(g.name), lower(w.product_name)) OR contains(lower(g.canonical_name), lower(w.product_name)))
SELECT product_name, sub_code FROM cand WHERE r = 1""")
def _category_of(t: Tables) -> DataFrame:
    whole = t.part.select(F.col("p_name").alias("product_name"))
    last = t.part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("product_name"))
    return C.category_of(whole.unionByName(last), _grouped(t))


def _grams_sql(text: str) -> str:
    """Trigrams of a text in their order, as the checking database says it."""
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"
    return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))"


#: Similarity of the gram set `a` to the best of all runs of the grams `b`.
BEST_RUN = """coalesce(list_max(flatten(list_transform(range(1, len(b) + 1), lambda i: list_transform(range(i, len(b) + 1), lambda j:
  CAST(len(list_intersect(a, b[i:j])) AS DOUBLE) / (len(a) + len(list_distinct(b[i:j])) - len(list_intersect(a, b[i:j]))))))), 0)"""


@query("sl06_alternatives", f"""
WITH {GROUPED},
source AS (SELECT s.id AS store_id, coalesce(m.source_store_id, s.id) AS source_store_id FROM stores s
  LEFT JOIN (SELECT store_id, min(source_store_id) AS source_store_id FROM store_price_source GROUP BY store_id) m ON m.store_id = s.id),
named AS (SELECT b.basket_id AS request_id, p.name AS product_name, b.basket_id % 100 AS store_id FROM baskets b JOIN products p ON p.id = b.product_id),
coded AS (SELECT *, coalesce(nullif(trim(group_sub_code), ''), nullif(trim(sub_code), '')) AS code FROM grouped),
category AS (SELECT product_name, code FROM (
  SELECT w.product_name, g.code, row_number() OVER (PARTITION BY w.product_name ORDER BY CASE WHEN lower(g.name) = lower(trim(w.product_name)) THEN 0 WHEN lower(g.canonical_name) = lower(trim(w.product_name)) THEN 1 ELSE 2 END, g.id) AS r
  FROM (SELECT DISTINCT product_name FROM named) w JOIN coded g ON g.code IS NOT NULL AND (contains(lower(g.name), lower(trim(w.product_name))) OR contains(lower(g.canonical_name), lower(trim(w.product_name))))) x WHERE r = 1),
asked AS (SELECT n.*, c.code, s.source_store_id, lower(trim(n.product_name)) AS wanted FROM named n JOIN category c USING (product_name) JOIN source s USING (store_id)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY collected_at DESC, price_id DESC) AS r FROM prices
  WHERE price > 0 AND collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 365 DAY) x WHERE r = 1),
stocked AS (SELECT l.store_id AS source_store_id, coalesce(nullif(trim(g.group_sub_code), ''), g.sub_code) AS code, g.dedup_key, lower(coalesce(nullif(trim(g.canonical_name), ''), g.name, '')) AS shown,
  CASE WHEN l.promo_price <> 0 THEN l.promo_price ELSE l.price END AS price, g.id, g.name FROM latest l JOIN grouped g ON g.id = l.product_id),
kinds AS (SELECT DISTINCT source_store_id, code, wanted FROM asked),
met AS (SELECT k.wanted, s.* FROM kinds k JOIN stocked s USING (source_store_id, code)),
scored AS (SELECT wanted, shown, {BEST_RUN} AS similarity FROM (SELECT wanted, shown, list_distinct({_grams_sql("wanted")}) AS a, {_grams_sql("shown")} AS b FROM (SELECT DISTINCT wanted, shown FROM met) m) g),
once AS (SELECT * FROM (SELECT m.*, z.similarity, row_number() OVER (PARTITION BY source_store_id, code, m.wanted, dedup_key ORDER BY similarity DESC, price, id) AS r FROM met m JOIN scored z ON z.wanted = m.wanted AND z.shown = m.shown) x WHERE r = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_store_id, code, wanted ORDER BY similarity DESC, price, name, id) AS position FROM once) x WHERE position <= 6)
SELECT a.request_id, a.store_id, b.id, b.dedup_key, a.code AS sub_code, b.similarity, b.price, CAST(b.position AS INTEGER) AS position
FROM asked a JOIN best b ON b.source_store_id = a.source_store_id AND b.code = a.code AND b.wanted = a.wanted""")
def _alternatives(t: Tables) -> DataFrame:
    source = S.effective_source(t.stores, t.store_price_source)
    requests = t.baskets.join(t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id").select(
        F.col("basket_id").alias("request_id"), "product_name", (F.col("basket_id") % 100).alias("store_id")
    )
    return C.alternatives(requests, _grouped(t), t.prices, source, PRICE_AS_OF, 365)


@query("ag30_brand_filter", f"""
WITH {ROLLUP}, seen AS (SELECT g.* FROM product_groups g WHERE CAST(g.id AS VARCHAR) IN (SELECT dedup_key FROM rollup WHERE min_price IS NOT NULL)),
b AS (SELECT sub_code, trim(brand) AS brand, count(*) AS n FROM seen WHERE trim(brand) <> '' GROUP BY 1, 2),
c AS (SELECT s.sub_code, count(*) AS total, count(nullif(trim(brand), '')) AS branded FROM seen s GROUP BY 1)
SELECT c.sub_code, CAST(total AS BIGINT) AS total_groups, CAST(branded AS BIGINT) AS branded_groups, CAST((SELECT count(*) FROM b WHERE b.sub_code = c.sub_code AND n >= 3) AS BIGINT) AS eligible_brands,
  CASE WHEN (SELECT count(*) FROM b WHERE b.sub_code = c.sub_code AND n >= 3) < 2 THEN 'insufficient_brands' WHEN CAST(branded AS DOUBLE) / total < 0.6 THEN 'insufficient_coverage' END AS reason FROM c""")
def _brand_filter(t: Tables) -> DataFrame:
    rows = C.brand_filter(t.product_groups, _rollup(t))
    return rows.select("sub_code", "total_groups", "branded_groups", "eligible_brands", "reason")


@query("ag31_category_tree_counts", """
WITH subs AS (SELECT n_nationkey AS id, n_regionkey AS main_id, CASE WHEN n_nationkey >= 10 THEN n_nationkey % 10 END AS parent_id FROM nation),
own AS (SELECT s.*, CAST((SELECT count(*) FROM part WHERE p_partkey % 23 = s.id) AS BIGINT) AS products FROM subs s)
SELECT 'main' AS level, CAST(main_id AS BIGINT) AS id, CAST(sum(products) AS BIGINT) AS products FROM own GROUP BY main_id
UNION ALL SELECT 'sub', id, products FROM own
UNION ALL SELECT 'family', o.id, CAST(o.products + coalesce((SELECT sum(c.products) FROM own c WHERE c.parent_id = o.id), 0) AS BIGINT) FROM own o""")
def _tree(t: Tables) -> DataFrame:
    products = t.product_categories.select(F.col("product_id").alias("id"), F.col("sub_id").cast("string").alias("sub_code"))
    mains = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"))
    subs = t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("main_id"),
        F.when(F.col("n_nationkey") >= 10, F.col("n_nationkey") % 10).alias("parent_id"), F.col("n_nationkey").cast("string").alias("code"),
    )
    tree = zip(("main", "sub", "family"), C.category_tree_counts(products, mains, subs))
    levels = [df.select(F.lit(level).alias("level"), F.col("id").cast("long").alias("id"), "products") for level, df in tree]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


@query("jn01_resolve_names", """
WITH k AS (SELECT DISTINCT lower(trim(line)) AS match_key FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) d UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT DISTINCT lower(p_brand) FROM part),
spoken AS (SELECT lower(p_name) AS s, p_partkey FROM part UNION ALL SELECT lower(p_brand), p_partkey FROM part WHERE p_partkey % 5 = 0)
SELECT k.match_key, min(s.p_partkey) AS product_id FROM k LEFT JOIN spoken s ON s.s = k.match_key WHERE k.match_key <> '' GROUP BY 1""")
def _resolve(t: Tables) -> DataFrame:
    keys = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).select(F.lower(F.trim("line")).alias("match_key"))
    keys = keys.unionByName(t.part.select(F.lower("p_name").alias("match_key"))).unionByName(t.part.select(F.lower("p_brand").alias("match_key")))
    aliases = t.part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("alias"))
    found, missing = resolve_names(keys, t.products, aliases)
    return found.select("match_key", "product_id").unionByName(missing.withColumn("product_id", F.lit(None).cast("bigint")))


# ---- staging and matching ----

STAGED = """
staged AS (SELECT concat('r', row_no) AS ext_id, trim(name) AS name, size_text, price, regexp_replace(ean_raw, '[^0-9]', '', 'g') AS d, row_no FROM scraped),
staging AS (SELECT ext_id, name, size_text, price, row_no, CASE WHEN length(d) = 14 AND d LIKE '0%' THEN substr(d, 2) WHEN length(d) = 12 THEN concat('0', d) WHEN length(d) IN (8, 13, 14) THEN d END AS ean_norm FROM staged),
eans AS (SELECT id AS product_id, ean AS ean_norm FROM products WHERE id % 3 <> 2),
manual AS (SELECT concat('r', p_partkey) AS ext_id, p_partkey AS product_id FROM part WHERE p_partkey % 4 = 1)
"""


def _staging(t: Tables) -> DataFrame:
    return t.scraped.select(
        F.concat(F.lit("r"), F.col("row_no")).alias("ext_id"), F.trim("name").alias("name"), "size_text", "price",
        codes.normalize_ean(F.col("ean_raw"), "staging").alias("ean_norm"), "row_no",
    )


def _eans(t: Tables) -> DataFrame:
    return t.products.filter("id % 3 <> 2").select(F.col("id").alias("product_id"), F.col("ean").alias("ean_norm"))


def _manual(t: Tables) -> DataFrame:
    return t.part.filter("p_partkey % 4 = 1").select(
        F.concat(F.lit("r"), F.col("p_partkey")).alias("ext_id"), F.col("p_partkey").alias("product_id"), F.lit(None).cast("string").alias("reason")
    )


MATCHES = f"""
{STAGED}, matches AS (
  SELECT s.ext_id, 'ean' AS method, e.product_id, s.name, s.size_text FROM staging s JOIN eans e ON e.ean_norm = s.ean_norm
  UNION ALL SELECT s.ext_id, 'manual', m.product_id, s.name, s.size_text FROM staging s JOIN manual m ON m.ext_id = s.ext_id LEFT JOIN eans e ON e.ean_norm = s.ean_norm WHERE e.product_id IS NULL),
grams AS (SELECT m.*, p.size_text AS product_size,
  list_distinct(flatten(list_transform(regexp_extract_all(lower(m.name), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))) AS a,
  list_distinct(flatten(list_transform(regexp_extract_all(lower(p.name), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))) AS b
  FROM matches m JOIN products p ON p.id = m.product_id),
preview AS (SELECT *, CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) AS name_sim FROM grams)
"""


@query("jn08_match_by_ean", f"WITH {STAGED} SELECT s.ext_id, e.product_id, s.price FROM staging s JOIN eans e ON e.ean_norm = s.ean_norm")
def _by_ean(t: Tables) -> DataFrame:
    return C.match_by_ean(_staging(t), _eans(t)).select("ext_id", "product_id", "price")


def _preview(t: Tables) -> DataFrame:
    return C.match_preview(_staging(t), _eans(t), _manual(t), t.products)


@query("jn09_match_preview", f"WITH {MATCHES} SELECT ext_id, method, product_id, round(name_sim, 9) AS name_sim, name_sim >= 0.55 AS name_ok FROM preview")
def _match_preview(t: Tables) -> DataFrame:
    return _preview(t).select("ext_id", "method", "product_id", F.round("name_sim", 9).alias("name_sim"), "name_ok")


@query("jn10_match_anomalies", f"""
WITH {MATCHES} SELECT ext_id, product_id FROM preview WHERE name_sim < 0.55 OR nullif(trim(size_text), '') IS DISTINCT FROM nullif(trim(product_size), '')""")
def _anomalies(t: Tables) -> DataFrame:
    return C.match_anomalies(_preview(t)).select("ext_id", "product_id")


@query("jn11_unmatched_queues", f"""
WITH {STAGED} SELECT 'with_ean' AS queue, ext_id FROM staging WHERE ean_norm IS NOT NULL AND ean_norm NOT IN (SELECT ean_norm FROM eans)
UNION ALL SELECT 'no_ean', ext_id FROM staging WHERE ean_norm IS NULL""")
def _queues(t: Tables) -> DataFrame:
    one = C.unmatched_with_ean(_staging(t), _eans(t)).select(F.lit("with_ean").alias("queue"), "ext_id")
    return one.unionByName(C.unmatched_no_ean(_staging(t)).select(F.lit("no_ean").alias("queue"), "ext_id"))


@query("ag42_staging_tally", f"""
WITH {STAGED} SELECT 'batch' AS kind, CAST(count(*) AS BIGINT) AS rows FROM staging WHERE row_no % 2 = 0 UNION ALL SELECT 'staging', CAST(count(*) AS BIGINT) FROM staging
UNION ALL SELECT 'matched', CAST(count(*) AS BIGINT) FROM staging WHERE ean_norm IN (SELECT ean_norm FROM eans)""")
def _tally(t: Tables) -> DataFrame:
    return C.staging_tally(_staging(t).filter("row_no % 2 = 0"), _staging(t), _eans(t))


# ---- grouping and upkeep ----

CANON_NAME = "lower(trim(name, ' ' || chr(9) || chr(10) || chr(13)))"


def _canon_sql(text: str) -> str:
    from cartwise.functions import vocab

    for prefix in vocab.CHAIN_PREFIXES:
        text = f"regexp_replace({text}, '{prefix}', '', 'i')"
    for _ in range(3):
        for ending in vocab.NAME_ENDINGS:
            text = f"trim(regexp_replace({text}, '{ending}', '', 'i'))"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


CANON = f"canon AS (SELECT row_no AS id, {_canon_sql(CANON_NAME)} AS canonical_name, category AS sub_code, name FROM scraped)"


@query("sf13_canonical_name", f"WITH {CANON} SELECT id, canonical_name FROM canon")
def _canonical(t: Tables) -> DataFrame:
    return t.scraped.select(F.col("row_no").alias("id"), names.canonical_name(F.col("name")).alias("canonical_name"))


def _scraped_products(t: Tables) -> DataFrame:
    return spread(t.scraped.select(F.col("row_no").alias("id"), "name", F.col("category").alias("sub_code")), t.rows("part"))


@query("ag32_build_groups", f"""
WITH {CANON}, g AS (SELECT canonical_name, sub_code, min(id) AS group_id FROM canon GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT g.group_id, c.id AS product_id FROM g JOIN canon c ON c.canonical_name = g.canonical_name AND c.sub_code = g.sub_code""")
def _build(t: Tables) -> DataFrame:
    return C.build_groups(_scraped_products(t))[1]


@query("ag32_group_preview", f"""
WITH {CANON} SELECT canonical_name, sub_code, CAST(count(*) AS BIGINT) AS member_count FROM canon GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY member_count DESC, canonical_name, sub_code LIMIT 30""")
def _group_preview(t: Tables) -> DataFrame:
    return C.group_preview(C.build_groups(_scraped_products(t))[0]).select("canonical_name", "sub_code", "member_count")


@query("pf11_kg_produce", """
SELECT row_no, name FROM scraped WHERE category IN ('ECONOMY', 'SMALL') AND (lower(name) LIKE '% kg%' OR lower(name) LIKE '%, kg' OR lower(name) LIKE '%kl kg%' OR lower(name) LIKE '%kl., kg%' OR lower(name) LIKE '% kg')""")
def _kg_produce(t: Tables) -> DataFrame:
    code = F.when(F.col("category").isin("ECONOMY", "SMALL"), F.lit("produce_x")).otherwise(F.lit("dry_x"))
    return t.scraped.withColumn("sub_code", code).filter(C.is_kg_produce()).select("row_no", "name")


@query("ag33_group_report", """
SELECT m.group_id, CAST(count(*) AS BIGINT) AS member_count, string_agg(DISTINCT p.name, ',' ORDER BY p.name) AS member_names, min(g.canonical_name) AS canonical_name
FROM product_group_members m JOIN products p ON p.id = m.product_id JOIN product_groups g ON g.id = m.group_id GROUP BY 1 ORDER BY member_count DESC, group_id LIMIT 10""")
def _report(t: Tables) -> DataFrame:
    rows = C.group_report(t.product_groups, t.product_group_members, t.products)
    return rows.select("group_id", "member_count", F.array_join("member_names", ",").alias("member_names"), "canonical_name")


@query("st03_table_counts", """
SELECT 'product_groups' AS tbl, CAST(count(*) AS BIGINT) AS rows FROM product_groups UNION ALL SELECT 'product_group_members', CAST(count(*) AS BIGINT) FROM product_group_members""")
def _counts(t: Tables) -> DataFrame:
    return C.table_counts(product_groups=t.product_groups, product_group_members=t.product_group_members)


@query("jn21_category_conflicts", """
SELECT m.group_id, m.product_id AS id FROM product_group_members m JOIN products p ON p.id = m.product_id JOIN product_groups g ON g.id = m.group_id
WHERE CASE WHEN p.id % 50 = 7 THEN 'moved' ELSE p.sub_code END IS DISTINCT FROM g.sub_code""")
def _conflicts(t: Tables) -> DataFrame:
    products = t.products.withColumn("sub_code", F.when(F.col("id") % 50 == 7, F.lit("moved")).otherwise(F.col("sub_code")))
    return C.category_conflicts(products, t.product_group_members, t.product_groups).select("group_id", "id")


QTY = r"""
raw AS (SELECT row_no AS id, name, category,
  regexp_matches(name, '(\d+)\s*[x×*]\s*(\d+)\s+(\d)\s*(kg|g|l|ml)\b', 'i') AS broken, regexp_matches(name, '(\d+)\s*[x×*]\s*(\d+[.,]?\d*)\s*(kg|g|l|ml)\b', 'i') AS multi,
  regexp_matches(name, '(\d+[.,]?\d*)\s*(kg|g|l|ml)\b', 'i') AS single, regexp_matches(name, '(^|[^0-9.,])kg\s*$', 'i') AS bare, lower(regexp_extract(name, '(\d+[.,]?\d*)\s*(kg|g|l|ml)\b', 2, 'i')) AS su FROM scraped),
q1 AS (SELECT *, CASE WHEN broken THEN CAST(concat(regexp_extract(name, '(\d+)\s*[x×*]\s*(\d+)\s+(\d)\s*(kg|g|l|ml)\b', 2, 'i'), '.', regexp_extract(name, '(\d+)\s*[x×*]\s*(\d+)\s+(\d)\s*(kg|g|l|ml)\b', 3, 'i')) AS DOUBLE)
   WHEN multi THEN TRY_CAST(replace(regexp_extract(name, '(\d+)\s*[x×*]\s*(\d+[.,]?\d*)\s*(kg|g|l|ml)\b', 2, 'i'), ',', '.') AS DOUBLE) WHEN single THEN TRY_CAST(replace(regexp_extract(name, '(\d+[.,]?\d*)\s*(kg|g|l|ml)\b', 1, 'i'), ',', '.') AS DOUBLE) END AS qty,
  lower(CASE WHEN broken THEN regexp_extract(name, '(\d+)\s*[x×*]\s*(\d+)\s+(\d)\s*(kg|g|l|ml)\b', 4, 'i') WHEN multi THEN regexp_extract(name, '(\d+)\s*[x×*]\s*(\d+[.,]?\d*)\s*(kg|g|l|ml)\b', 3, 'i') ELSE su END) AS unit FROM raw),
q2 AS (SELECT *, qty * CASE WHEN unit IN ('kg', 'l') THEN 1000 ELSE 1 END AS base, CASE unit WHEN 'kg' THEN 'g' WHEN 'l' THEN 'ml' ELSE unit END AS bu FROM q1),
q3 AS (SELECT *, CASE WHEN bare AND NOT multi AND su <> 'kg' THEN 'SKIP_KG_PRICED' WHEN broken THEN 'WOULD_SET_MULTIPACK_RECOVERED_DECIMAL' WHEN multi THEN 'WOULD_SET_MULTIPACK'
  WHEN single AND base < 15 AND floor(base) NOT IN (8, 10, 12, 14) THEN 'SKIP_AMBIGUOUS_SMALL_QTY' WHEN single THEN 'WOULD_SET_SINGLE' ELSE 'SKIP_UNPARSEABLE' END AS status FROM q2)
"""


@query("sf08_parse_quantity", f"WITH {QTY} SELECT id, status, CASE WHEN status LIKE 'WOULD%' THEN base END AS net_qty, CASE WHEN status LIKE 'WOULD%' THEN bu END AS net_unit FROM q3")
def _parse(t: Tables) -> DataFrame:
    from cartwise.functions.sizes import parse_quantity

    parsed = t.scraped.select(F.col("row_no").alias("id"), parse_quantity(F.col("name")).alias("q"))
    return parsed.select("id", "q.status", F.col("q.net_qty").cast("double").alias("net_qty"), "q.net_unit")


def _parsed(t: Tables) -> DataFrame:
    products = _scraped_products(t)
    groups, members = C.build_groups(products)
    return C.parsed_quantities(products, members, groups.withColumnRenamed("group_id", "id"))


CLASSED = f"""
{QTY}, {CANON}, g AS (SELECT canonical_name, sub_code, min(id) AS group_id FROM canon GROUP BY 1, 2 HAVING count(*) >= 2),
mem AS (SELECT g.group_id, q.id, q.status, base, bu, CASE WHEN broken THEN '10' WHEN multi THEN regexp_extract(q.name, '(\\d+)\\s*[x×*]', 1, 'i') ELSE '1' END AS pc
        FROM g JOIN canon c ON c.canonical_name = g.canonical_name AND c.sub_code = g.sub_code JOIN q3 q ON q.id = c.id),
mixed AS (SELECT group_id FROM mem WHERE status LIKE 'WOULD%' GROUP BY 1 HAVING count(DISTINCT concat(base, bu, pc)) > 1),
classed AS (SELECT group_id, id, CASE WHEN status LIKE 'WOULD%' AND group_id IN (SELECT group_id FROM mixed) THEN 'SKIP_GROUP_CONFLICT' ELSE status END AS status FROM mem)
"""


@query("ag34_quantity_conflicts", f"WITH {CLASSED} SELECT group_id, id, status FROM classed")
def _quantity_conflicts(t: Tables) -> DataFrame:
    return _parsed(t).select("group_id", "id", "status")


@query("ag35_class_report", f"WITH {CLASSED} SELECT status, CAST(count(*) AS BIGINT) AS rows FROM classed GROUP BY 1")
def _class_report(t: Tables) -> DataFrame:
    return C.class_report(_parsed(t))[0]


@query("ag35_class_samples", f"WITH {CLASSED} SELECT status, id FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY id) AS r FROM classed) x WHERE r <= 15")
def _class_samples(t: Tables) -> DataFrame:
    return C.class_report(_parsed(t))[1].select("status", "id")


@query("ag28_catalog_health", """
SELECT chain, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE id IN (SELECT product_id FROM prices)) AS BIGINT) AS with_price,
  CAST(count(*) FILTER (WHERE coalesce(image_url, '') <> '') AS BIGINT) AS with_image FROM products GROUP BY 1""")
def _health(t: Tables) -> DataFrame:
    return C.catalog_health(t.products, t.prices)


@query("jn12_ungrouped", "SELECT sub_code, CAST(count(*) AS BIGINT) AS cnt FROM products WHERE id NOT IN (SELECT product_id FROM product_group_members) GROUP BY 1")
def _ungrouped(t: Tables) -> DataFrame:
    return C.ungrouped(t.products, t.product_group_members)


@query("jn13_without_price", f"""
SELECT sub_code, CAST(count(*) AS BIGINT) AS cnt FROM products WHERE id NOT IN {FRESH_IDS} GROUP BY 1 ORDER BY cnt DESC, sub_code LIMIT 5""")
def _without_price(t: Tables) -> DataFrame:
    from cartwise.common import fresh

    return C.without_price(t.products, fresh(t.prices, PRICE_AS_OF, 14))


@query("jn14_misplaced_products", f"""
WITH p AS (SELECT product_id, store_id FROM prices WHERE collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 365 DAY)
SELECT DISTINCT x.id FROM products x JOIN p ON p.product_id = x.id JOIN stores s ON s.id = p.store_id WHERE x.chain = 'asia' AND s.name LIKE '%0%'
AND x.id NOT IN (SELECT p2.product_id FROM p p2 JOIN stores s2 ON s2.id = p2.store_id WHERE s2.name NOT LIKE '%00000001%')
AND s.name LIKE '%00000001%'""")
def _misplaced(t: Tables) -> DataFrame:
    from cartwise.common import fresh

    return C.misplaced_products(t.products, fresh(t.prices, PRICE_AS_OF, 365), t.stores, "asia", "%00000001%")


@query("pf19_gallery", """
SELECT id, name FROM products WHERE coalesce(image_url, '') = '' AND (contains(lower(name), 'red') OR contains(lower(brand), 'red')) ORDER BY id DESC LIMIT 100""")
def _gallery(t: Tables) -> DataFrame:
    return C.gallery(t.products, missing=True, text=" RED ").select("id", "name")


@query("pf17_image_worklists", """
SELECT 'missing' AS kind, id FROM products WHERE coalesce(image_url, '') = '' AND source_url LIKE '%rimi%'
UNION ALL SELECT 'unhosted', id FROM products WHERE coalesce(image_url, '') <> '' AND image_url NOT LIKE 'https://img.example/1%'
UNION ALL SELECT 'by_ean', id FROM products WHERE coalesce(image_url, '') = '' AND length(ean) >= 8""")
def _worklists(t: Tables) -> DataFrame:
    one = C.image_worklist(t.products, "missing", host="rimi").select(F.lit("missing").alias("kind"), "id")
    two = C.image_worklist(t.products, "unhosted", hosted="https://img.example/1").select(F.lit("unhosted").alias("kind"), "id")
    return one.unionByName(two).unionByName(C.image_worklist(t.products, "by_ean").select(F.lit("by_ean").alias("kind"), "id"))


@query("jn29_products_by_host", "SELECT id, source_url FROM products WHERE source_url LIKE '%rimi%' ORDER BY id DESC LIMIT 25")
def _by_host(t: Tables) -> DataFrame:
    return C.products_by_host(t.products, "Rimi", 25, at="id").select("id", "source_url")


@query("ag29_scrape_freshness", """
WITH seen AS (SELECT p.id, p.chain, CASE WHEN p.id % 17 = 0 THEN NULL ELSE p.sub_code END AS sub_code, max(x.seen_at) AS last_seen_utc FROM products p LEFT JOIN prices x ON x.product_id = p.id GROUP BY 1, 2, 3)
SELECT chain, CAST(epoch(max(last_seen_utc)) AS BIGINT) AS last_update, CAST(count(*) FILTER (WHERE last_seen_utc >= TIMESTAMP '2001-11-10 00:00:00' - INTERVAL 1 DAY) AS BIGINT) AS updated_today,
  CAST(count(*) FILTER (WHERE sub_code IS NULL) AS BIGINT) AS without_category FROM seen GROUP BY 1""")
def _freshness(t: Tables) -> DataFrame:
    newest = t.prices.groupBy(F.col("product_id").alias("id")).agg(F.max("seen_at").alias("last_seen_utc"))
    products = t.products.join(newest, "id", "left").withColumn("sub_code", F.when(F.col("id") % 17 != 0, F.col("sub_code")))
    rows = C.scrape_freshness(products, "2001-11-10 00:00:00")
    return rows.withColumn("last_update", F.unix_seconds(F.col("last_update").cast("timestamp")))


def _selections(t: Tables) -> DataFrame:
    lines = dealt(t.baskets, t.rows("lineitem"), "user_id", "product_id")
    return lines.groupBy("user_id", "product_id").agg(F.sum("quantity").alias("count"), F.max("basket_id").alias("last_used"))


@query("ag36_selection_totals", """
SELECT b.user_id, coalesce(CAST(m.group_id AS VARCHAR), concat('u_', b.product_id)) AS dedup_key, CAST(sum(quantity) AS BIGINT) AS selection_count
FROM baskets b LEFT JOIN product_group_members m ON m.product_id = b.product_id GROUP BY 1, 2""")
def _totals(t: Tables) -> DataFrame:
    return C.selection_totals(_selections(t), t.product_group_members, t.rows("lineitem"))


@query("sl10_my_selections", """
SELECT user_id, product_id, CAST(r AS BIGINT) AS position FROM (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY sum(quantity) DESC, max(basket_id) DESC, product_id) AS r
FROM baskets GROUP BY 1, 2) x WHERE r <= 10""")
def _mine(t: Tables) -> DataFrame:
    return C.my_selections(_selections(t), 10).select("user_id", "product_id", F.col("position").cast("long").alias("position"))


@query("sl03_personal_order", f"""
WITH {GROUPED}, tot AS (SELECT coalesce(CAST(m.group_id AS VARCHAR), concat('u_', b.product_id)) AS dedup_key, CAST(sum(quantity) AS BIGINT) AS selection_count
  FROM baskets b LEFT JOIN product_group_members m ON m.product_id = b.product_id WHERE b.user_id = 7 GROUP BY 1),
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {RANK}, CASE WHEN coalesce(image_url, '') <> '' THEN 0 ELSE 1 END, CASE WHEN coalesce(ean, '') <> '' THEN 0 ELSE 1 END, id) AS r FROM grouped) x WHERE r = 1)
SELECT b.id, coalesce(t.selection_count, 0) AS selection_count FROM base b LEFT JOIN tot t ON t.dedup_key = b.dedup_key
ORDER BY 2 DESC, coalesce(nullif(trim(canonical_name), ''), name, ''), id LIMIT 30""")
def _personal(t: Tables) -> DataFrame:
    mine = C.selection_totals(_selections(t).filter("user_id = 7"), t.product_group_members).drop("user_id")
    rows = C.browse_dedupe(_grouped(t)).join(mine, "dedup_key", "left").na.fill(0, ["selection_count"])
    return C.paginate(rows, C.browse_order(personal=True), 30).select("id", "selection_count")


@query("jn25_favourites", f"""
WITH {ROLLUP}, {GROUPED}, fav AS (SELECT DISTINCT user_id, product_id FROM baskets WHERE quantity >= 40)
SELECT f.user_id, f.product_id, coalesce(nullif(trim(g.canonical_name), ''), g.name, '') AS name, r.min_price
FROM fav f JOIN grouped g ON g.id = f.product_id LEFT JOIN rollup r ON r.dedup_key = g.dedup_key""")
def _favourites(t: Tables) -> DataFrame:
    picked = t.baskets.filter("quantity >= 40").select("user_id", "product_id").distinct()
    rows = C.favourites(picked, t.products, t.product_group_members, t.product_groups, _rollup(t))
    return rows.select("user_id", "product_id", "name", "min_price")


@query("sf16_word_similarity", f"""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS wanted, p_type AS kind FROM part), n AS (SELECT DISTINCT p_name AS shown, p_type AS kind FROM part),
g AS (SELECT wanted, shown, kind, list_distinct({_grams_sql("wanted")}) AS a, {_grams_sql("shown")} AS b FROM w JOIN n USING (kind))
SELECT wanted, shown, kind, round(similarity, 9) AS similarity FROM (SELECT *, {BEST_RUN} AS similarity FROM g) x WHERE similarity >= 0.3""")
def _word_similarity(t: Tables) -> DataFrame:
    wanted = t.part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("wanted"), F.col("p_type").alias("kind"))
    shown = t.part.select(F.col("p_name").alias("shown"), F.col("p_type").alias("kind"))
    return X.similar_pairs(wanted, shown, "kind", 0.3).withColumn("similarity", F.round("similarity", 9))


@query("sf15_trigram_similarity", """
WITH n AS (SELECT DISTINCT p_type, p_name FROM part), f AS (SELECT p_type, min(p_name) AS first_name FROM part GROUP BY 1),
g AS (SELECT n.p_name, f.first_name,
  list_distinct(flatten(list_transform(regexp_extract_all(lower(n.p_name), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))) AS a,
  list_distinct(flatten(list_transform(regexp_extract_all(lower(f.first_name), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3))))) AS b
  FROM n JOIN f ON f.p_type = n.p_type)
SELECT p_name, first_name, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS similarity FROM g""")
def _trigrams(t: Tables) -> DataFrame:
    first = t.part.groupBy("p_type").agg(F.min("p_name").alias("first_name"))
    rows = t.part.select("p_type", "p_name").distinct().join(first, "p_type")
    return rows.select("p_name", "first_name", F.round(similarity.trigram_similarity(F.col("p_name"), F.col("first_name")), 9).alias("similarity"))
