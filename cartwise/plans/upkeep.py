"""Queries of the merge jobs and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.common import settled
from cartwise.functions import codes
from cartwise.operators import baskets as B
from cartwise.operators import merges as M
from cartwise.operators import recipes as R
from cartwise.operators import stores as S
from cartwise.plans.catalogue import QTY
from cartwise.plans.registry import query
from cartwise.sources.adapters import PRICE_AS_OF, Tables

OLD_NEW = """
old AS (SELECT ext_id, name, price FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY row_no) AS r FROM scraped WHERE row_no % 3 <> 0) x WHERE r = 1),
new AS (SELECT ext_id, name, price + 1 AS price FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY row_no DESC) AS r FROM scraped WHERE row_no % 2 = 0 OR row_no % 3 = 0) x WHERE r = 1)
"""


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.scraped.select("ext_id", "name", "price", F.col("row_no").alias("arrival"))
    old = M.dedupe_batch(rows.filter("arrival % 3 <> 0"), "ext_id").drop("arrival")
    new = M.dedupe_batch(rows.filter("arrival % 2 = 0 OR arrival % 3 = 0"), "ext_id", keep="last").drop("arrival").withColumn("price", F.col("price") + 1)
    return old, new


@query("me01_merge_overwrite", f"WITH {OLD_NEW} SELECT ext_id, name, price FROM new UNION ALL SELECT ext_id, name, price FROM old WHERE ext_id NOT IN (SELECT ext_id FROM new)")
def _overwrite(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return M.merge_overwrite(old, new, "ext_id")


@query("me20_dedupe_batch", "SELECT ext_id, min(row_no) AS first_row, max(row_no) AS last_row FROM scraped GROUP BY 1")
def _batch(t: Tables) -> DataFrame:
    rows = t.scraped.select("ext_id", F.col("row_no").alias("arrival"))
    first = M.dedupe_batch(rows, "ext_id").withColumnRenamed("arrival", "first_row")
    return first.join(M.dedupe_batch(rows, "ext_id", keep="last").withColumnRenamed("arrival", "last_row"), "ext_id")


COAL = """
old AS (SELECT row_no, name, trim(brand) AS brand, size_text, price FROM scraped WHERE row_no % 3 <> 0),
new AS (SELECT row_no, CASE WHEN row_no % 5 = 1 THEN NULL ELSE upper(name) END AS name, CASE WHEN row_no % 2 = 0 THEN '' ELSE brand_raw END AS brand, size_text, CASE WHEN row_no % 7 = 0 THEN NULL ELSE price * 2 END AS price FROM scraped WHERE row_no % 4 <> 1 OR row_no % 3 = 0)
"""


@query("me02_merge_coalesce", f"""
WITH {COAL} SELECT coalesce(o.row_no, n.row_no) AS row_no, coalesce(n.name, o.name) AS name, coalesce(nullif(n.brand, ''), o.brand) AS brand, coalesce(n.size_text, o.size_text) AS size_text, coalesce(n.price, o.price) AS price
FROM old o FULL OUTER JOIN new n ON n.row_no = o.row_no""")
def _coalesce(t: Tables) -> DataFrame:
    old = t.scraped.filter("row_no % 3 <> 0").select("row_no", "name", F.trim("brand").alias("brand"), "size_text", "price")
    new = t.scraped.filter("row_no % 4 <> 1 OR row_no % 3 = 0").select(
        "row_no", F.when(F.col("row_no") % 5 != 1, F.upper("name")).alias("name"),
        F.when(F.col("row_no") % 2 == 0, "").otherwise(F.col("brand_raw")).alias("brand"), "size_text",
        F.when(F.col("row_no") % 7 != 0, F.col("price") * 2).alias("price"),
    )
    return M.merge_coalesce(old, new, "row_no", blank=("brand",))


@query("me03_write_prices", """
SELECT product_id, store_id, price FROM (SELECT product_id, store_id, price, row_number() OVER (PARTITION BY product_id, store_id ORDER BY seen_at DESC NULLS LAST, price) AS r FROM prices) x WHERE r = 1""")
def _write(t: Tables) -> DataFrame:
    early = t.prices.filter("seen_at < TIMESTAMP '1999-01-01 00:00:00'")
    late = t.prices.filter("seen_at >= TIMESTAMP '1999-01-01 00:00:00'")
    nothing = early.limit(0)
    current, history = M.write_prices(nothing, nothing, late)
    current, _ = M.write_prices(current, history, early)
    return current.select("product_id", "store_id", "price")


@query("me03_price_history", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(price) AS BIGINT) AS total FROM prices")
def _history(t: Tables) -> DataFrame:
    batch = t.prices.select("product_id", "store_id", "price", "seen_at")
    nothing = batch.limit(0)
    _, history = M.write_prices(nothing, nothing, batch)
    return history.agg(F.count("*").alias("n"), F.sum("price").alias("total"))


UPSERT = """
base AS (SELECT id, ean FROM products WHERE id % 3 = 0),
batch AS (SELECT row_no, nullif(regexp_replace(coalesce(ean_raw, ''), '[^0-9]', '', 'g'), '') AS ean, trim(name) AS name, price FROM scraped),
looked AS (SELECT b.*, k.id AS known FROM batch b LEFT JOIN base k ON k.ean = b.ean),
makers AS (SELECT row_no, ean FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(ean, concat('row', row_no)) ORDER BY row_no) AS r FROM looked WHERE known IS NULL) x WHERE r = 1),
made AS (SELECT row_no, ean, (SELECT max(id) FROM base) + row_number() OVER (ORDER BY row_no) AS id FROM makers)
"""


@query("me04_upsert_products", f"""
WITH {UPSERT} SELECT coalesce(l.known, a.id, b.id) AS product_id, l.row_no AS store_id, l.price
FROM looked l LEFT JOIN made a ON a.ean = l.ean LEFT JOIN made b ON b.row_no = l.row_no AND l.ean IS NULL""")
def _upsert(t: Tables) -> DataFrame:
    base = t.products.filter("id % 3 = 0").select("id", "ean", "name")
    batch = t.scraped.select(
        F.col("row_no").alias("arrival"), "ean_raw", "name", "size_text", "brand", F.col("row_no").alias("store_id"), "price", F.lit(None).cast("timestamp").alias("collected_at")
    )
    _, snapshots = M.upsert_products(base, batch)
    return snapshots.select("product_id", "store_id", "price")


@query("me05_upsert_catalog", """
WITH b AS (SELECT row_no, price, CASE WHEN row_no % 6 = 0 THEN price - 5 END AS promo_price, CASE WHEN row_no % 9 = 7 THEN ean_raw END AS ean FROM scraped),
lnk AS (SELECT row_no, p_partkey - p_partkey % 2 AS product_id FROM scraped JOIN part ON p_partkey = row_no WHERE row_no % 4 <> 3),
top AS (SELECT * FROM (SELECT l.product_id, b.*, row_number() OVER (PARTITION BY l.product_id ORDER BY b.price, concat('x', b.row_no)) AS r FROM b JOIN lnk l ON l.row_no = b.row_no WHERE b.price > 0) x WHERE r = 1)
SELECT product_id, price, promo_price FROM top""")
def _catalog(t: Tables) -> DataFrame:
    batch = t.scraped.select(
        F.concat(F.lit("x"), F.col("row_no")).alias("ext_id"), "price", F.when(F.col("row_no") % 6 == 0, F.col("price") - 5).alias("promo_price"),
        F.when(F.col("row_no") % 9 == 7, F.col("ean_raw")).alias("ean"), F.lit("").alias("image_url"),
    )
    links = t.scraped.filter("row_no % 4 <> 3").select(
        F.lit("feed").alias("source"), F.concat(F.lit("x"), F.col("row_no")).alias("ext_id"), (F.col("row_no") - F.col("row_no") % 2).alias("product_id")
    )
    prices = t.prices.filter("store_id = 10").select("product_id", "store_id", "price", "promo_price", "collected_at", F.lit("old").alias("source"))
    _, after = M.upsert_catalog(t.products, prices, links, batch, "feed", 10, PRICE_AS_OF)
    return after.filter("source = 'feed'").select("product_id", "price", "promo_price")


ADOPT = """
queue AS (SELECT row_no, ext_id2 AS ext_id, name, price, CASE WHEN length(d) = 14 AND d LIKE '0%' THEN substr(d, 2) WHEN length(d) = 12 THEN concat('0', d) WHEN length(d) IN (8, 13, 14) THEN d END AS ean_norm
          FROM (SELECT *, concat('c', row_no) AS ext_id2, regexp_replace(ean_raw, '[^0-9]', '', 'g') AS d FROM scraped) z),
eans AS (SELECT id AS product_id, ean AS ean_norm FROM products WHERE id % 3 <> 2),
looked AS (SELECT q.*, e.product_id AS known FROM queue q LEFT JOIN eans e ON e.ean_norm = q.ean_norm WHERE q.ean_norm IS NOT NULL),
made AS (SELECT ean_norm, (SELECT max(id) FROM products) + row_number() OVER (ORDER BY row_no) AS id FROM (SELECT *, row_number() OVER (PARTITION BY ean_norm ORDER BY ext_id) AS r FROM looked WHERE known IS NULL) x WHERE r = 1),
resolved AS (SELECT l.ext_id, coalesce(l.known, m.id) AS product_id, l.price FROM looked l LEFT JOIN made m ON m.ean_norm = l.ean_norm)
"""


def _adopted(t: Tables) -> dict[str, DataFrame]:
    queue = t.scraped.select(
        F.col("row_no").alias("arrival"), F.concat(F.lit("c"), F.col("row_no")).alias("ext_id"), "name", "ean_raw",
        codes.normalize_ean(F.col("ean_raw"), "staging").alias("ean_norm"), "price",
    )
    eans = t.products.filter("id % 3 <> 2").select(F.col("id").alias("product_id"), F.col("ean").alias("ean_norm"))
    no_map = t.part.limit(0).select(F.lit("").alias("ext_id"), F.col("p_partkey").alias("product_id"), F.lit("").alias("source"))
    no_prices = t.prices.limit(0).select("product_id", "store_id", "price", "collected_at", F.lit("").alias("source"))
    return M.adopt_candidates(queue, t.products, eans, no_map, no_prices, t.stores, "Asia", "feed", PRICE_AS_OF)


@query("me06_adopt_candidates", f"WITH {ADOPT} SELECT ext_id, product_id FROM resolved")
def _adopt(t: Tables) -> DataFrame:
    return _adopted(t)["ext_product_map"].select("ext_id", "product_id")


@query("me06_adopted_prices", f"""
WITH {ADOPT} SELECT product_id, price, (SELECT min(id) FROM stores WHERE chain = 'asia' AND is_online) AS store_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ext_id DESC) AS r FROM resolved) x WHERE r = 1""")
def _adopted_prices(t: Tables) -> DataFrame:
    return _adopted(t)["prices"].select("product_id", "price", "store_id")


@query("me06_queue_left", f"WITH {ADOPT} SELECT ext_id FROM queue WHERE ean_norm IS NULL")
def _queue_left(t: Tables) -> DataFrame:
    return _adopted(t)["queue"].select("ext_id")


@query("me08_merge_shared_baskets", """
WITH RECURSIVE lines AS (SELECT min(l_suppkey) % 50 AS family_id, l_orderkey * 10 + l_linenumber AS arrival, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber),
items AS (SELECT family_id, arrival, CASE WHEN p % 7 <> 0 THEN concat('p', p) WHEN p % 3 <> 0 THEN concat('iing', p % 40) END AS ident, lower(concat_ws(' ', p_name, p_brand)) AS name
  FROM lines JOIN part ON p_partkey = p),
old AS (SELECT p_partkey % 50 AS family_id, CASE WHEN p_partkey % 2 = 0 THEN concat('p', p_partkey) END AS ident, lower(concat_ws(' ', p_name, p_brand)) AS name FROM part WHERE p_partkey % 11 = 0),
marked AS (SELECT i.*, row_number() OVER (PARTITION BY family_id, ident, name ORDER BY arrival) AS nth,
  EXISTS (SELECT 1 FROM old o WHERE o.family_id = i.family_id AND o.ident = i.ident) AS known,
  EXISTS (SELECT 1 FROM old o WHERE o.family_id = i.family_id AND o.name = i.name AND o.ident IS NULL) AS broken,
  EXISTS (SELECT 1 FROM old o WHERE o.family_id = i.family_id AND o.name = i.name) AS taken FROM items i),
free AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY arrival) AS k FROM marked WHERE ident IS NOT NULL AND NOT known AND nth = 1 AND (broken OR NOT taken)),
fold AS (
  SELECT DISTINCT family_id, CAST(0 AS BIGINT) AS k, false AS won, false AS repaired, CAST([] AS VARCHAR[]) AS idents, CAST([] AS VARCHAR[]) AS names FROM free
  UNION ALL
  SELECT family_id, k, won, won AND broken, CASE WHEN won THEN list_append(idents, ident) ELSE idents END, CASE WHEN won THEN list_append(names, name) ELSE names END FROM (
    SELECT f.family_id, r.k, r.broken, r.ident, r.name, f.idents, f.names, NOT list_contains(f.idents, r.ident) AND NOT list_contains(f.names, r.name) AS won
    FROM fold f JOIN free r ON r.family_id = f.family_id AND r.k = f.k + 1) x)
SELECT c.family_id, CAST(coalesce(w.added, 0) AS BIGINT) AS added, CAST(c.n - c.rejected - coalesce(w.added, 0) - coalesce(w.repaired, 0) AS BIGINT) AS skipped, CAST(coalesce(w.repaired, 0) AS BIGINT) AS repaired, CAST(c.rejected AS BIGINT) AS rejected
FROM (SELECT family_id, count(*) AS n, count(*) FILTER (WHERE ident IS NULL) AS rejected FROM items GROUP BY 1) c
LEFT JOIN (SELECT family_id, count(*) FILTER (WHERE won AND NOT repaired) AS added, count(*) FILTER (WHERE repaired) AS repaired FROM fold GROUP BY 1) w ON w.family_id = c.family_id""")
def _shared(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("_p"))
    items = lines.select(
        (F.col("s") % 50).alias("family_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), F.when(F.col("_p") % 7 != 0, F.col("_p")).alias("product_id"),
        F.when((F.col("_p") % 7 == 0) & (F.col("_p") % 3 != 0), F.concat(F.lit("ing"), F.col("_p") % 40)).alias("ingredient_name_en"), "_p",
    )
    named = items.join(t.part.select(F.col("p_partkey").alias("_p"), F.concat_ws(" ", "p_name", "p_brand").alias("product_name")), "_p").drop("_p")
    existing = t.part.filter("p_partkey % 11 = 0").select(
        (F.col("p_partkey") % 50).alias("family_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("product_id"),
        F.lit(None).cast("string").alias("ingredient_name_en"), F.concat_ws(" ", "p_name", "p_brand").alias("product_name"),
    )
    return M.merge_counts(M.merge_shared_baskets(existing, named))


@query("me09_bump_selections", "SELECT user_id, product_id, CAST(count(*) AS BIGINT) AS count, max(basket_id) AS last_used FROM baskets GROUP BY 1, 2")
def _bump(t: Tables) -> DataFrame:
    picks = t.baskets.select("user_id", "product_id", F.col("basket_id").alias("at"))
    half = M.bump_selections(picks.limit(0).select("user_id", "product_id", F.lit(0).cast("long").alias("count"), F.col("at").alias("last_used")), picks.filter("at % 2 = 0"), t.rows("lineitem"))
    return M.bump_selections(half, picks.filter("at % 2 <> 0"), t.rows("lineitem"))


@query("me10_apply_quantities", f"""
WITH {QTY} SELECT p.id, CAST(CASE WHEN p.net_qty IS NULL AND q.status LIKE 'WOULD%' THEN q.base ELSE p.net_qty END AS DOUBLE) AS net_qty FROM products p JOIN q3 q ON q.id = p.id""")
def _quantities(t: Tables) -> DataFrame:
    from cartwise.functions.sizes import parse_quantity

    parsed = t.scraped.select(F.col("row_no").alias("id"), parse_quantity(F.col("name")).alias("q")).filter("q.status LIKE 'WOULD%'").select("id", "q.net_qty", "q.net_unit", "q.pack_count")
    products = t.products.select("id", "name", F.col("net_qty").cast("decimal(18,3)").alias("net_qty"), "net_unit", "pack_count")
    after, _ = M.apply_quantities(products, parsed, commit=True)
    return after.select("id", F.col("net_qty").cast("double").alias("net_qty"))


FOUND = """
cat AS (SELECT id, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '11111111' WHEN 3 THEN 'abc' ELSE ean END AS ean FROM products),
found AS (SELECT id AS product_id, CASE id % 5 WHEN 0 THEN '22222222' WHEN 1 THEN lpad(CAST(4740000000000 + id - id % 4 AS VARCHAR), 13, '0') WHEN 2 THEN ean ELSE lpad(CAST(5740000000000 + id - id % 3 AS VARCHAR), 13, '0') END AS ean FROM products),
o1 AS (SELECT f.product_id, f.ean, c.ean AS prev,
  CASE WHEN regexp_matches(f.ean, '^(0{8}|1{8}|2{8})$') THEN 'BOGUS_CANDIDATE' WHEN coalesce(c.ean, '') <> '' AND c.ean = f.ean THEN 'EXISTS'
       WHEN coalesce(c.ean, '') <> '' AND regexp_matches(c.ean, '^([0-9]{8}|[0-9]{13})$') AND NOT regexp_matches(c.ean, '^1{8}$') THEN 'SKIP_NOT_BAD'
       WHEN EXISTS (SELECT 1 FROM cat x WHERE x.ean = f.ean AND x.id <> f.product_id) THEN 'DUP_FOUND' WHEN coalesce(c.ean, '') <> '' THEN 'OVERWRITE' ELSE 'OK' END AS o
  FROM found f JOIN cat c ON c.id = f.product_id)
"""


@query("me11_apply_eans", f"""
WITH {FOUND} SELECT product_id, CASE WHEN o IN ('OK', 'OVERWRITE') AND product_id <> (SELECT min(y.product_id) FROM o1 y WHERE y.ean = o1.ean AND y.o IN ('OK', 'OVERWRITE')) THEN 'DUP_FOUND' ELSE o END AS outcome FROM o1""")
def _eans(t: Tables) -> DataFrame:
    kind = F.col("id") % 6
    cat = t.products.select("id", F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, "11111111").when(kind == 3, "abc").otherwise(F.col("ean")).alias("ean"))
    which = F.col("id") % 5
    made = lambda base, step: F.lpad((F.lit(base) + F.col("id") - F.col("id") % step).cast("string"), 13, "0")
    found = t.products.select(
        F.col("id").alias("product_id"), F.when(which == 0, "22222222").when(which == 1, made(4740000000000, 4)).when(which == 2, F.col("ean")).otherwise(made(5740000000000, 3)).alias("ean")
    )
    outcomes, _ = M.apply_eans(cat, found, overwrite_bad=True)
    return outcomes.select("product_id", "outcome")


@query("me13_clear_images", "SELECT id, CASE WHEN id % 3 <> 1 THEN image_url END AS image_url FROM products")
def _clear(t: Tables) -> DataFrame:
    urls = t.products.filter("id % 3 = 1").select(F.col("image_url").alias("url")).filter("url <> ''")
    return M.clear_images(t.products.withColumn("image_url", F.when((F.col("id") % 3 == 1) & (F.col("image_url") == ""), None).otherwise(F.col("image_url"))), urls).select("id", "image_url")


@query("me14_erase_users", """
WITH gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 4 = 1), members AS (SELECT c_nationkey + 100 * (c_custkey % 40) AS family_id, c_custkey AS user_id, c_custkey AS joined_at FROM customer),
fam AS (SELECT family_id AS id, max(user_id) AS owner_id FROM members GROUP BY 1),
stay AS (SELECT * FROM members WHERE user_id NOT IN (SELECT user_id FROM gone))
SELECT f.id, CASE WHEN f.owner_id IN (SELECT user_id FROM gone) THEN (SELECT min(user_id) FROM stay s WHERE s.family_id = f.id) ELSE f.owner_id END AS owner_id
FROM fam f WHERE f.id IN (SELECT family_id FROM stay)""")
def _erase(t: Tables) -> DataFrame:
    members = t.customer.select((F.col("c_nationkey") + 100 * (F.col("c_custkey") % 40)).alias("family_id"), F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("joined_at"))
    families = members.groupBy(F.col("family_id").alias("id")).agg(F.max("user_id").alias("owner_id"))
    gone = t.customer.filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("user_id"))
    return M.erase_users({"baskets": t.baskets}, families, members, gone)["families"]


@query("me15_live_baskets", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def _live(t: Tables) -> DataFrame:
    history = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return B.live_baskets(history).select("id")


@query("me19_skip_known", "SELECT row_no FROM scraped b WHERE NOT EXISTS (SELECT 1 FROM scraped s WHERE s.row_no % 2 = 0 AND s.store_host = b.store_host AND s.ean_raw = b.ean_raw)")
def _skip(t: Tables) -> DataFrame:
    rows = t.scraped.select("row_no", "store_host", F.col("ean_raw").alias("ean_norm"))
    return M.skip_known(rows, rows.filter("row_no % 2 = 0")).select("row_no")


@query("me12_upsert_stores", """
WITH inc AS (SELECT chain, CASE WHEN id % 5 = 0 THEN concat(name, ' new') ELSE name END AS name, 1.0E0 AS lat, 2.0E0 AS lon FROM stores WHERE id % 2 = 0)
SELECT s.id, coalesce(s.name, i.name) AS name, coalesce(s.lat, i.lat) AS lat FROM stores s FULL OUTER JOIN inc i ON i.chain = s.chain AND i.name = s.name""")
def _stores(t: Tables) -> DataFrame:
    incoming = t.stores.filter("id % 2 = 0").select(
        "chain", F.when(F.col("id") % 5 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"),
        F.lit("addr").alias("address"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(False).alias("is_online"),
    )
    return S.upsert_stores(t.stores.withColumn("address", F.lit(None).cast("string")), incoming).select("id", "name", "lat")


@query("me17_store_overwrite", """
WITH inc AS (SELECT name, 5.0E0 AS lat FROM stores WHERE id % 3 = 0) SELECT s.name, coalesce(i.lat, s.lat) AS lat FROM stores s LEFT JOIN inc i ON i.name = s.name""")
def _store_overwrite(t: Tables) -> DataFrame:
    old = t.stores.select("name", "lat")
    return M.merge_overwrite(old, old.filter(F.col("name").isin("")).unionByName(t.stores.filter("id % 3 = 0").select("name", F.lit(5.0).alias("lat"))), "name")


@query("me18_dedupe_stores", """
WITH r AS (SELECT id, concat('Store ', id % 30) AS name, lat FROM stores) SELECT name, id AS arrival, lat FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN lat IS NULL THEN 1 ELSE 0 END, id) AS n FROM r) x WHERE n = 1""")
def _dedupe_stores(t: Tables) -> DataFrame:
    rows = t.stores.select(F.concat(F.lit(" Store  "), F.col("id") % 30).alias("name"), F.lit("").alias("address"), "lat", "lon", F.col("id").alias("arrival"))
    return S.dedupe_stores(rows).select("name", "arrival", "lat")


@query("pf18_flag_missing_images", "SELECT id, nullif(image_url, '') AS image_url, CASE WHEN coalesce(image_url, '') = '' THEN 'Kontrolli visuaali!' ELSE '' END AS note FROM products")
def _flag(t: Tables) -> DataFrame:
    rows = M.flag_missing_images(t.products.withColumn("note", F.lit("")))
    return M.flag_missing_images(rows).select("id", "image_url", "note")


@query("pf21_default_source", "SELECT coalesce(source_url, 'unknown') AS source, CAST(count(*) AS BIGINT) AS n FROM products GROUP BY 1")
def _default(t: Tables) -> DataFrame:
    return t.products.na.fill("unknown", ["source_url"]).groupBy(F.col("source_url").alias("source")).agg(F.count("*").alias("n"))


@query("jn20_apply_labels", """
WITH l AS (SELECT doc_id % 700 AS product_id, CASE WHEN quality = 1 THEN concat('m', doc_id % 9) ELSE ' ' END AS main_code, CASE WHEN toxic = 0 THEN concat('s', doc_id % 9) END AS sub_code, doc_id FROM labels),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY doc_id DESC) AS r FROM l) z WHERE r = 1)
SELECT p.id, coalesce(nullif(trim(x.main_code), ''), 'none') AS food_group, coalesce(nullif(trim(x.sub_code), ''), p.sub_code) AS sub_code FROM products p LEFT JOIN x ON x.product_id = p.id""")
def _labels(t: Tables) -> DataFrame:
    updates = t.labels.select(
        (F.col("doc_id") % 700).alias("product_id"), F.when(F.col("quality") == 1, F.concat(F.lit("m"), F.col("doc_id") % 9)).otherwise(" ").alias("main_code"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("s"), F.col("doc_id") % 9)).alias("sub_code"), F.col("doc_id").alias("arrival"),
    )
    return M.apply_labels(t.products.withColumn("food_group", F.lit("none")), updates).select("id", "food_group", "sub_code")


@query("ag38_label_stats", """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE coalesce(size_text, '') = '') AS BIGINT) AS no_food_group, CAST(count(*) FILTER (WHERE coalesce(image_url, '') = '') AS BIGINT) AS no_sub_code FROM products""")
def _label_stats(t: Tables) -> DataFrame:
    return M.label_stats(t.products.select(F.col("size_text").alias("food_group"), F.col("image_url").alias("sub_code")))[0]


@query("ag38_largest_food_groups", "SELECT sub_code AS food_group, CAST(count(*) AS BIGINT) AS cnt FROM products GROUP BY 1 ORDER BY cnt DESC, food_group LIMIT 20")
def _food_groups(t: Tables) -> DataFrame:
    return M.label_stats(t.products.withColumn("food_group", F.col("sub_code")))[1]


@query("jn27_shared_basket_view", """
SELECT b.basket_id, b.product_id, CASE WHEN c_custkey % 3 = 0 THEN concat('u', c_custkey) ELSE c_mktsegment END AS added_by FROM baskets b LEFT JOIN customer ON c_custkey = b.user_id""")
def _view(t: Tables) -> DataFrame:
    users = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(" ").alias("first_name"),
        F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@x.ee")).alias("email"),
    )
    return M.shared_basket_view(t.baskets, users).select("basket_id", "product_id", "added_by")


@query("jn28_apply_images", """
WITH imgs AS (SELECT p_name AS product, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS manufacturer, concat('img', p_partkey) AS image_url, p_partkey AS arrival FROM part WHERE p_partkey % 9 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, manufacturer ORDER BY arrival DESC) AS r FROM imgs) x WHERE r = 1)
SELECT p.id, coalesce(e.image_url, g.image_url, p.image_url) AS image_url FROM products p
LEFT JOIN l e ON e.product = p.name AND e.manufacturer = p.brand LEFT JOIN l g ON g.product = p.name AND g.manufacturer = ''""")
def _images(t: Tables) -> DataFrame:
    images = t.part.filter("p_partkey % 9 = 0").select(
        F.upper("p_name").alias("product"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise("").alias("manufacturer"), F.lit("").alias("amount"),
        F.concat(F.lit("img"), F.col("p_partkey")).alias("image_url"), F.col("p_partkey").alias("arrival"),
    )
    prices = t.products.select("id", F.col("name").alias("product"), F.col("brand").alias("manufacturer"), F.lit(None).cast("string").alias("amount"), "image_url", F.lit("").alias("note"))
    return M.apply_images(prices, images).select("id", "image_url")


# ---- recipes ----

LOOKUP = """
lookup AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS ingredient, split_part(p_name, ' ', 2) AS term FROM part)
"""
INGREDIENTS = f"""
{LOOKUP}, cand AS (SELECT l.ingredient, p.* FROM lookup l JOIN products p ON contains(lower(p.name), l.term) AND p.sub_code NOT IN ('sub_promo')),
low AS (SELECT product_id, min(CASE WHEN promo_price <> 0 THEN promo_price ELSE price END) AS price FROM prices WHERE price > 0 AND collected_at > TIMESTAMP '{PRICE_AS_OF}' - INTERVAL 14 DAY GROUP BY 1),
per AS (SELECT ingredient, CASE WHEN chain = 'africa' THEN 'asia' ELSE chain END AS chain, min(l.price) AS price FROM cand c JOIN low l ON l.product_id = c.id GROUP BY 1, 2)
"""


def _lookup(t: Tables) -> DataFrame:
    codes_ = F.array(*[F.lit(f"sub_{c}") for c in ("economy", "standard", "small", "medium", "large")])
    word = F.get(F.split("p_name", " "), F.lit(1))
    return t.part.select(word.alias("ingredient")).distinct().select("ingredient", F.array(F.upper("ingredient")).alias("search_terms"), codes_.alias("sub_codes"))


def per_chain(t: Tables) -> DataFrame:
    return R.ingredient_prices(R.ingredient_candidates(_lookup(t), t.products), t.prices, PRICE_AS_OF, aliases={"africa": "asia"})


@query("pf09_ingredient_candidates", f"""
WITH {LOOKUP} SELECT l.ingredient, p.id FROM lookup l JOIN products p ON contains(lower(p.name), l.term) AND p.sub_code IN ('sub_economy', 'sub_standard', 'sub_small', 'sub_medium', 'sub_large')""")
def _candidates(t: Tables) -> DataFrame:
    return R.ingredient_candidates(_lookup(t), t.products).select("ingredient", "id")


@query("ag09_ingredient_prices", f"WITH {INGREDIENTS} SELECT ingredient, chain, price FROM per")
def _ingredient_prices(t: Tables) -> DataFrame:
    return per_chain(t).select("ingredient", "chain", "price")


@query("ag10_ingredient_best", f"WITH {INGREDIENTS} SELECT ingredient, min(price) AS price FROM per GROUP BY 1")
def _best(t: Tables) -> DataFrame:
    return R.ingredient_best(per_chain(t)).select("ingredient", "price")


RECIPES = "items AS (SELECT DISTINCT basket_id AS recipe_id, split_part(p_name, ' ', 2) AS ingredient FROM baskets JOIN part ON p_partkey = product_id)"


@query("ag09_price_recipes", f"""
WITH {INGREDIENTS}, {RECIPES}, ch AS (SELECT DISTINCT i.recipe_id, p.chain FROM items i JOIN per p ON p.ingredient = i.ingredient)
SELECT c.recipe_id, c.chain, CAST(count(p.price) AS BIGINT) AS covered, CAST(count(*) AS BIGINT) AS total, CAST(sum(p.price) AS BIGINT) AS total_price,
  coalesce(string_agg(CASE WHEN p.price IS NULL THEN i.ingredient END, ',' ORDER BY i.ingredient), '') AS not_found
FROM ch c JOIN items i ON i.recipe_id = c.recipe_id LEFT JOIN per p ON p.ingredient = i.ingredient AND p.chain = c.chain GROUP BY 1, 2""")
def _price_recipes(t: Tables) -> DataFrame:
    words = t.part.select(F.col("p_partkey").alias("product_id"), F.get(F.split("p_name", " "), F.lit(1)).alias("ingredient"), F.lit(True).alias("known"))
    items = t.keyed_baskets(words).filter("known").select(F.col("basket_id").alias("recipe_id"), "ingredient")
    rows = R.price_recipes(items, settled(per_chain(t)))
    return rows.select("recipe_id", "chain", "covered", "total", "total_price", F.array_join("not_found", ",").alias("not_found"))


@query("sf19_unpivot_ingredients", """
SELECT p_partkey AS meal_id, 1 AS slot, p_name AS name_en, CAST(p_size AS VARCHAR) AS measure FROM part
UNION ALL SELECT p_partkey, 3, p_brand, '' FROM part WHERE p_partkey % 2 = 0""")
def _unpivot(t: Tables) -> DataFrame:
    cols = {f"strIngredient{i}": F.lit("") for i in range(1, 21)} | {f"strMeasure{i}": F.lit(None).cast("string") for i in range(1, 21)}
    cols["strIngredient1"], cols["strMeasure1"] = F.concat(F.lit(" "), F.col("p_name")), F.concat(F.col("p_size").cast("string"), F.lit(" "))
    cols["strIngredient3"] = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ")
    meals = t.part.withColumns(cols).withColumnRenamed("p_partkey", "meal_id")
    return R.unpivot_ingredients(meals).select("meal_id", "slot", "name_en", "measure")
