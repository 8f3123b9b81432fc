"""Queries of the cleaning functions and of page extraction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.common import spread
from cartwise.functions import codes, geo, money, names, sizes, vocab, web
from cartwise.operators import baskets as B
from cartwise.operators import catalog as C
from cartwise.plans.registry import query
from cartwise.sources import files
from cartwise.sources.adapters import Tables

D = "regexp_replace(ean_raw, '[^0-9]', '', 'g')"


@query("sf01_haversine", """
SELECT id, round(2*6371*asin(sqrt(pow(sin(radians((lat-58.5)/2)),2)+cos(radians(58.5))*cos(radians(lat))*pow(sin(radians((lon-25.0)/2)),2))), 6) AS km FROM stores""")
def _haversine(t: Tables) -> DataFrame:
    return t.stores.select("id", F.round(geo.haversine_km(F.lit(58.5), F.lit(25.0), F.col("lat"), F.col("lon")), 6).alias("km"))


VALID = "regexp_matches({c}, '^[0-9]{{13}}$') AND (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({c}, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 = CAST(substr({c}, 13, 1) AS INT)"


@query("sf02_normalize_ean", f"""
SELECT row_no, nullif({D}, '') AS digits,
  CASE WHEN length({D}) = 14 AND {D} LIKE '0%' THEN substr({D}, 2) WHEN length({D}) = 12 THEN concat('0', {D}) WHEN length({D}) IN (8, 13, 14) THEN {D} END AS staging,
  CASE WHEN length({D}) = 14 AND substr({D}, 1, 1) IN ('0', '1') THEN substr({D}, 2) WHEN length({D}) = 12 THEN concat('0', {D}) WHEN length({D}) IN (8, 13) THEN {D} END AS logistic FROM scraped""")
def _eans(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", *[codes.normalize_ean(F.col("ean_raw"), v).alias(v) for v in ("digits", "staging", "logistic")])


@query("sf03_valid_ean13", f"""
WITH c AS (SELECT row_no, CASE WHEN regexp_matches({D}, '^[0-9]{{13}}$') THEN {D} END AS code FROM scraped)
SELECT row_no, CASE WHEN code IS NULL THEN false ELSE {VALID.format(c="code")} END AS valid FROM c""")
def _valid(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", codes.is_valid_ean13(codes.digits(F.coalesce("ean_raw", F.lit("")))).alias("valid"))


@query("pf16_bad_ean", f"SELECT row_no, ({D} IS NULL OR NOT regexp_matches({D}, '^([0-9]{{8}}|[0-9]{{13}})$') OR {D} = '11111111') AS bad FROM scraped")
def _bad(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", codes.is_bad_ean(codes.digits(F.col("ean_raw"))).alias("bad"))


@query("sf04_parse_price_text", r"""
SELECT row_no, CAST(CASE WHEN regexp_matches(price_text, '^\d+\s*%+$') THEN NULL
  WHEN regexp_matches(price_text, '\d\s*€\s*\d{1,2}') THEN concat(regexp_extract(price_text, '(\d+)\s*€\s*(\d{1,2})', 1), '.', rpad(regexp_extract(price_text, '(\d+)\s*€\s*(\d{1,2})', 2), 2, '0'))
  WHEN regexp_matches(price_text, '\d+[,.]\d{1,2}') THEN concat(regexp_extract(price_text, '(\d+)[,.](\d{1,2})', 1), '.', rpad(regexp_extract(price_text, '(\d+)[,.](\d{1,2})', 2), 2, '0'))
  WHEN regexp_matches(price_text, '\d+\s+\d{2}') THEN replace(regexp_extract(price_text, '\d+\s+\d{2}', 0), ' ', '.')
  WHEN length(regexp_replace(price_text, '[^0-9]', '', 'g')) > 2 THEN CAST(CAST(regexp_replace(price_text, '[^0-9]', '', 'g') AS DOUBLE) / 100 AS VARCHAR) END AS DOUBLE) AS price FROM scraped""")
def _price_text(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", money.parse_price_text(F.col("price_text")).cast("double").alias("price"))


@query("sf04_price_text_variants", r"""
SELECT row_no, CAST(CASE WHEN regexp_matches(price_text, '^\d+ \d+$') AND length(replace(price_text, ' ', '')) >= 3 THEN CAST(replace(price_text, ' ', '') AS DOUBLE) / 100 ELSE TRY_CAST(replace(price_text, ',', '.') AS DOUBLE) END AS DOUBLE) AS spaced,
  TRY_CAST(nullif(regexp_extract(replace(price_text, ',', '.'), '(\d+\.\d{2})', 1), '') AS DOUBLE) AS shop,
  round(TRY_CAST(nullif(regexp_extract(replace(price_text, ',', '.'), '(\d+(?:\.\d*)?)', 1), '') AS DOUBLE), 2) AS first_number FROM scraped""")
def _price_variants(t: Tables) -> DataFrame:
    read = lambda v: money.parse_price_text(F.col("price_text"), v).cast("double")
    return t.scraped.select("row_no", read("spaced").alias("spaced"), read("shop").alias("shop"), read("first").alias("first_number"))


@query("sf05_minor_to_major", """
SELECT row_no, CASE WHEN row_no % 2 = 0 OR v > 100 THEN round(v / 100, 2) ELSE v END AS cents,
  CASE WHEN (row_no % 2 = 0 AND v > 100) OR (row_no % 2 = 1 AND v >= 100) THEN round(v / 100, 2) ELSE v END AS over_100,
  CASE WHEN row_no % 2 = 0 AND v >= 100 THEN round(v / 100, 2) ELSE v END AS digits FROM (SELECT row_no, CAST(price % 250 AS DOUBLE) AS v FROM scraped) x""")
def _minor(t: Tables) -> DataFrame:
    rows = t.scraped.select("row_no", (F.col("price") % 250).cast("double").alias("v"))
    return rows.select("row_no", *[money.minor_to_major(F.col("v"), v, F.col("row_no") % 2 == 0).alias(v) for v in ("cents", "over_100", "digits")])


@query("sf06_size_from_name", r"""
WITH x AS (SELECT row_no, trim(regexp_replace(name, '\s+', ' ', 'g')) AS n FROM scraped)
SELECT row_no, replace(CASE WHEN regexp_matches(n, '(\d+)\s*[x×]\s*(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b', 'i')
  THEN concat(regexp_extract(n, '(\d+)\s*[x×]\s*(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b', 1, 'i'), '×', replace(regexp_extract(n, '(\d+)\s*[x×]\s*(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b', 2, 'i'), ',', '.'), ' ', lower(regexp_extract(n, '(\d+)\s*[x×]\s*(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b', 3, 'i')))
  WHEN regexp_matches(n, '(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b', 'i') THEN concat(replace(regexp_extract(n, '(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b', 1, 'i'), ',', '.'), ' ', lower(regexp_extract(n, '(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b', 2, 'i'))) ELSE '' END, ' pcs', ' tk') AS size FROM x""")
def _size(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", sizes.size_from_name(F.col("name")).alias("size"))


@query("sf07_parse_size_text", r"""
WITH x AS (SELECT row_no, size_text, regexp_matches(size_text, '^\s*(\d+)\s*[x×]\s*([\d.,]+)\s*(ml|l|g|kg)\s*$', 'i') AS p, regexp_matches(size_text, '^\s*([\d.,]+)\s*(ml|l|g|kg)\s*$', 'i') AS s FROM scraped),
y AS (SELECT *, CASE WHEN p THEN CAST(regexp_extract(size_text, '^\s*(\d+)', 1) AS BIGINT) WHEN s THEN CAST(1 AS BIGINT) END AS pack_count,
  CASE WHEN p THEN replace(regexp_extract(size_text, '[x×]\s*([\d.,]+)', 1, 'i'), ',', '.') WHEN s THEN replace(regexp_extract(size_text, '([\d.,]+)', 1), ',', '.') END AS q, lower(regexp_extract(size_text, '(ml|l|g|kg)\s*$', 1, 'i')) AS u FROM x)
SELECT row_no, pack_count, CAST(q AS DOUBLE) * CASE WHEN u IN ('kg', 'l') THEN 1000 ELSE 1 END AS net_qty, CASE WHEN q IS NOT NULL THEN CASE u WHEN 'kg' THEN 'g' WHEN 'l' THEN 'ml' ELSE u END END AS net_unit FROM y""")
def _size_text(t: Tables) -> DataFrame:
    parsed = t.scraped.select("row_no", sizes.parse_size_text(F.col("size_text")).alias("s"))
    return parsed.select("row_no", "s.pack_count", F.col("s.net_qty").cast("double").alias("net_qty"), "s.net_unit")


@query("sf09_normalize_unit", "SELECT id, CASE WHEN net_unit IN ('g', 'ml') THEN net_unit END AS unit, CASE WHEN net_unit IN ('g', 'ml') THEN CAST(1 AS BIGINT) END AS factor FROM products")
def _unit(t: Tables) -> DataFrame:
    rows = t.products.select("id", sizes.normalize_unit(F.concat(F.lit(" "), F.upper("net_unit"))).alias("u"))
    return rows.select("id", "u.unit", F.col("u.factor").cast("long").alias("factor"))


@query("sf10_effective_quantity", "SELECT id, CASE WHEN net_qty > 0 AND net_qty <= 100000 THEN net_qty * pack_count END AS qty FROM products")
def _effective(t: Tables) -> DataFrame:
    return t.products.select("id", sizes.effective_qty(F.col("net_qty"), F.col("pack_count")).alias("qty"))


@query("sf11_clean_brand", """
SELECT row_no, CASE row_no % 6 WHEN 1 THEN 'Määramata' WHEN 2 THEN '' WHEN 3 THEN '' ELSE concat('Farm ', regexp_extract(brand_raw, '([0-9]+)', 1)) END AS brand FROM scraped""")
def _brand(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", names.clean_brand(F.col("brand_raw")).alias("brand"))


@query("sf12_unaccent", "SELECT doc_id, md5(translate(text, 'äöõüšžÄÖÕÜŠŽ', 'aoouszAOOUSZ')) AS plain FROM documents")
def _unaccent(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(names.unaccent(F.col("text"))).alias("plain"))


@query("sf12_slug", "SELECT doc_id, md5(trim(regexp_replace(lower(translate(text, 'äöõüšžÄÖÕÜŠŽ', 'aoouszAOOUSZ')), '[^a-z0-9]+', '-', 'g'), '-')) AS slug FROM documents")
def _slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(names.slug(F.col("text"))).alias("slug"))


@query("sf14_strip_own_brand", """
SELECT row_no, CASE WHEN name LIKE 'Coop %' AND category IN ('ECONOMY', 'SMALL')
    AND lower(split_part(ltrim(substr(name, 6)), ' ', 1)) NOT IN ('mahe', 'öko', 'eko', 'organic', 'bio') THEN substr(name, 6) ELSE name END AS name
FROM (SELECT row_no, category, replace(name, 'Coop red', 'Coop mahe') AS name FROM scraped) x""")
def _own_brand(t: Tables) -> DataFrame:
    path = F.when(F.col("category").isin("ECONOMY", "SMALL"), F.lit("/tooted/food-market/x")).otherwise(F.lit("/muu"))
    name = F.replace("name", F.lit("Coop red"), F.lit("Coop mahe"))
    return t.scraped.select("row_no", names.strip_own_brand(name, path).alias("name"))


def _replaced(column: str) -> str:
    for old, new in vocab.ENCODING_REPAIRS:
        column = f"replace({column}, '{old}', '{new}')" if "\n" not in old else f"replace({column}, ' olu' || chr(10), ' õlu' || chr(10))"
    return column


@query("sf17_repair_encoding", f"SELECT doc_id, md5(CASE WHEN regexp_matches(lower(text), '{'|'.join(vocab.ENCODING_SKIP_WORDS)}') THEN text ELSE {_replaced('text')} END) AS fixed FROM documents")
def _encoding(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(names.repair_encoding(F.col("text"))).alias("fixed"))


_WORDS = ("Chicken breast", "fresh Basil leaves", "Olive Oil", "widget", "2 large potatoes", "salt", "Vanilla pod", "unknown thing", "water", "eggs")
_MEASURES = ("2 tbsp", "1 cup chopped", "3 cloves minced", "100g", "1 Large", "juice of 1", "to taste", "finely sliced", "2 lb", "a pinch")
_PICK = lambda options, col: "CASE " + col + f" % {len(options)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(options)) + " END"


def _picked(options, column: str):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.col(column) % len(options) + 1).cast("int"))


def _exact(low: str) -> str:
    return f"CASE {low} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.INGREDIENTS.items()) + " END"


def _inside(low: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, '{k}') THEN '{v}'" for k, v in vocab.INGREDIENTS.items()) + " END"


@query("sf18_translate_ingredient", f"""
WITH w AS (SELECT p_partkey AS id, concat({_PICK(_WORDS, 'p_partkey')}, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_name) ELSE '' END) AS w FROM part)
SELECT id, coalesce({_exact('lower(trim(w))')}, {_inside('lower(trim(w))')}, w) AS name FROM w""")
def _ingredient(t: Tables) -> DataFrame:
    word = F.concat(_picked(_WORDS, "p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(""))
    return t.part.select(F.col("p_partkey").alias("id"), names.translate_ingredient(word).alias("name"))


def _measured(text: str) -> str:
    for word, local in vocab.MEASURES.items():
        text = f"regexp_replace({text}, '\\b{re.escape(word).replace(chr(92) + ' ', ' ').replace(chr(92) + '-', '-')}\\b', '{local}', 'gi')"
    return text


@query("sf18_translate_measure", f"""
WITH w AS (SELECT p_partkey AS id, {_PICK(_MEASURES, 'p_partkey')} AS w FROM part), d AS (SELECT DISTINCT w FROM w), m AS (SELECT w, {_measured('trim(w)')} AS measure FROM d)
SELECT w.id, m.measure FROM w JOIN m ON m.w = w.w""")
def _measure(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), names.translate_measure(_picked(_MEASURES, "p_partkey")).alias("measure"))


@query("pf10_skip_ingredients", f"""
WITH w AS (SELECT p_partkey AS id, {_PICK(_WORDS, 'p_partkey')} AS name_en FROM part) SELECT id, name_en FROM w WHERE name_en NOT IN ('salt', 'water')""")
def _skip(t: Tables) -> DataFrame:
    from cartwise.operators.recipes import drop_skip_ingredients

    return drop_skip_ingredients(t.part.select(F.col("p_partkey").alias("id"), _picked(_WORDS, "p_partkey").alias("name_en")))


_CLEAN = "regexp_replace(regexp_replace(url, '[?#].*$', ''), ':[0-9]+(:[0-9]+)?$', '')"


@query("sf29_canonical_url", f"""
SELECT row_no, CASE WHEN url LIKE 'https://evil%' THEN NULL ELSE rtrim(replace({_CLEAN}, '/e-selver/', '/'), '/') END AS clean FROM scraped""")
def _canonical(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", codes.canonical_url(F.col("url"), ["www.selver.ee", "shop.rimi.ee"], "/e-selver").alias("clean"))


@query("sf29_canonical_page_url", "SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS clean FROM pages")
def _canonical_page(t: Tables) -> DataFrame:
    return t.pages.select("page_id", codes.canonical_url(F.col("url")).alias("clean"))


@query("sf28_external_ids", """
SELECT row_no, coalesce(nullif(regexp_extract(url, '/p/([0-9]+)', 1), ''), nullif(regexp_extract(url, '-([0-9]+)$', 1), ''), right(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-'), 120)) AS from_url,
  CASE WHEN row_no % 3 = 0 THEN concat('wolt:', substr(md5(concat(store_host, '|', name)), 1, 16)) ELSE concat('wolt:', row_no) END AS item FROM scraped""")
def _external(t: Tables) -> DataFrame:
    item = F.when(F.col("row_no") % 3 == 0, " ").otherwise(F.col("row_no").cast("string"))
    return t.scraped.select(
        "row_no", codes.id_from_url(F.col("url")).alias("from_url"), codes.external_id("item", item_id=item, host=F.col("store_host"), name=F.col("name")).alias("item")
    )


@query("sf30_cdn_image_url", """
SELECT id, concat('https://cdn.example/', substr(ean, 1, 1), '/', substr(ean, 2, 1), '/', ean, '.jpg') AS by_ean FROM products""")
def _cdn(t: Tables) -> DataFrame:
    return t.products.select("id", codes.cdn_image_url("ean", F.concat(F.lit(" "), F.col("ean")), "https://cdn.example").alias("by_ean"))


@query("sf31_ip_hash", "SELECT event_id, substr(sha256(concat('10.0.0.', user_id)), 1, 16) AS h FROM events")
def _ip(t: Tables) -> DataFrame:
    return t.events.select("event_id", codes.ip_hash(F.concat(F.lit("10.0.0."), F.col("user_id"))).alias("h"))


# HMAC by its definition: the key "secret", padded to 64 bytes, with each byte xor 0x36 and 0x5c
INNER, OUTER = "455355445342" + "36" * 58, "2f393f2e3928" + "5c" * 58


@query("sf31_device_key", f"""
SELECT event_id, CASE WHEN trim(coalesce(device_key, '')) <> '' THEN sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(trim(device_key))))) END AS device_key
FROM analytics_events""")
def _device(t: Tables) -> DataFrame:
    return t.analytics_events.select("event_id", codes.device_key(F.col("device_key"), "secret").alias("device_key"))


@query("sf43_owner_uuid", """
SELECT c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)),
  concat(substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3)), substr(h, 21, 12)) AS owner
FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('grocery-user:', c_custkey))) AS h FROM customer) x""")
def _owner(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", codes.owner_uuid(F.col("c_custkey").cast("string")).alias("owner"))


_CITIES = ("Tartu Kvartali", "PÄRNU mnt", "Lasnamäe", "parnu keskus", "Saku", "Prnu")


@query("sf32_infer_city", f"SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'tartu' WHEN 1 THEN 'parnu' WHEN 3 THEN 'parnu' WHEN 5 THEN 'parnu' ELSE 'tallinn' END AS city FROM part")
def _city(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), names.infer_city(_picked(_CITIES, "p_partkey")).alias("city"))


_PRODUCE = ("Tšillipaprika", "Kirsstomat", "Lillkapsas", "Suvikõrvits", "Tomat ja kurk", "Sai", "Punane sibul")


@query("sf33_produce_family", """
SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'chili' WHEN 1 THEN 'tomato' WHEN 2 THEN 'cauliflower' WHEN 3 THEN 'zucchini' WHEN 6 THEN 'onion' END AS family FROM part""")
def _family(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), names.produce_family(F.concat_ws(" ", _picked(_PRODUCE, "p_partkey"), F.col("p_name"))).alias("family"))


@query("sf34_tokens", """
SELECT doc_id, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('või', 'with', 'ilma', 'bio', 'mahe'))) AS BIGINT) AS n FROM documents""")
def _tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(names.tokens(F.col("text"))).cast("long").alias("n"))


@query("sf34_title_matches", """
SELECT p_partkey AS id, p_partkey % 3 <> 2 AS ok FROM part""")
def _title(t: Tables) -> DataFrame:
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", F.col("p_name"), F.lit("suur 500"))).when(F.col("p_partkey") % 3 == 1, F.lit("Valio piim")).otherwise("täiesti muu")
    brand = F.when(F.col("p_partkey") % 3 == 1, F.lit("VALIO")).otherwise("")
    return t.part.select(F.col("p_partkey").alias("id"), names.title_matches(title, F.col("p_name"), brand, F.lit("500 g")).alias("ok"))


@query("sl11_best_hit", """
WITH q AS (SELECT c_custkey AS query_id, p_name AS q, p_brand AS brand FROM customer JOIN part ON p_partkey = c_custkey),
h AS (SELECT q.query_id, p_partkey AS position, CASE WHEN contains(p_name, split_part(q.q, ' ', 1)) THEN 1 ELSE 0 END + CASE WHEN split_part(q.q, ' ', 2) <> split_part(q.q, ' ', 1) AND contains(p_name, split_part(q.q, ' ', 2)) THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(concat(p_name, ' ', p_brand)), lower(q.brand)) THEN 2 ELSE 0 END AS score FROM q JOIN part ON p_partkey % 1500 = query_id)
SELECT query_id, position, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS r FROM h) x WHERE r = 1""")
def _hit(t: Tables) -> DataFrame:
    asked = t.customer.join(t.part, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("query_id"), F.col("p_name").alias("q"), F.col("p_brand").alias("brand"))
    titles = t.part.select((F.col("p_partkey") % 1500).alias("query_id"), F.col("p_partkey").alias("position"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    return C.best_hit(asked, titles, names.hit_score(F.col("q"), F.col("brand"), F.lit(""), F.col("title"))).select("query_id", "position", "score")


@query("sf35_choose_name", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_brand ELSE p_type END AS name FROM part""")
def _choose(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 4
    first = F.when(kind == 0, F.col("p_name")).when(kind == 1, " ").when(kind == 2, "Tooted").otherwise(F.col("p_type"))
    second = F.when(kind == 3, F.lit("pood")).otherwise(F.col("p_brand"))
    return t.part.select(F.col("p_partkey").alias("id"), names.choose_name(F.array(first, second), F.lit("pood"), ("tooted",)).alias("name"))


@query("sf35_join_crumbs", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, ' / ', p_name) ELSE concat(p_type, ' / ', p_name, ' / ', p_type) END AS path FROM part")
def _crumbs(t: Tables) -> DataFrame:
    crumbs = F.array(F.col("p_type"), F.concat(F.lit(" "), F.lower("p_type")), F.lit(""), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_type")))
    return t.part.select(F.col("p_partkey").alias("id"), names.join_crumbs(crumbs).alias("path"))


@query("sf36_size_from_description", "SELECT row_no, coalesce(size_text, '') AS size FROM scraped")
def _description(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Hea toode\nSuurus, maht: "), F.coalesce("size_text", F.lit("")), F.lit("\nmuu"))
    return t.scraped.select("row_no", sizes.size_from_description(F.when(F.col("size_text").isNotNull(), text).otherwise("Hea toode")).alias("size"))


@query("sf37_coords_from_url", """
SELECT id, CASE WHEN id % 4 < 3 THEN lat END AS lat, CASE WHEN id % 4 < 3 THEN lon END AS lon, CASE WHEN id % 4 = 3 OR lat IS NULL THEN name END AS query FROM stores""")
def _coords(t: Tables) -> DataFrame:
    pair = F.format_string("%.2f,%.2f", "lat", "lon")
    kind = F.when(F.col("lat").isNull(), 3).otherwise(F.col("id") % 4)
    url = (
        F.when(kind == 0, F.concat(F.lit("https://www.google.com/maps/@"), pair, F.lit(",15z"))).when(kind == 1, F.concat(F.lit("https://maps.google.com/?q="), F.url_encode(pair)))
        .when(kind == 2, F.concat(F.lit("https://maps.google.com/dir?x=1&destination="), pair)).otherwise(F.concat(F.lit("https://maps.google.com/?q="), F.url_encode("name")))
    )
    return t.stores.select("id", geo.coords_from_url(url).alias("c")).select("id", "c.*")


@query("sf38_plausible_address", "SELECT id, id % 3 = 0 AS ok FROM stores")
def _address(t: Tables) -> DataFrame:
    line = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Pärnu mnt "), F.col("id"))).when(F.col("id") % 3 == 1, F.concat(F.lit("info"), F.col("id"), F.lit("@x.ee tn 5"))).otherwise("tel 12345678")
    return t.stores.select("id", names.plausible_address(line).alias("ok"))


@query("sf38_clean_store_name", "SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Mustamäe Selver' WHEN 2 THEN 'Ringtee Selver' ELSE '' END AS name FROM stores")
def _store_name(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(F.lit("e-Selver"), F.lit("Mustamäe  Selver E-P 8-22"), F.lit("Tartu Ringtee Selver"), F.lit("Selver")), (F.col("id") % 4 + 1).cast("int"))
    return t.stores.select("id", names.clean_store_name(raw).alias("name"))


@query("sf39_guess_brand", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN 'FARMI' ELSE '' END AS brand FROM part")
def _guess(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 4
    specs = F.when(kind == 1, F.create_map(F.lit("Muu"), F.lit("x"), F.lit("Kaubamärk"), F.col("p_type"))).otherwise(F.create_map(F.lit("Muu"), F.lit("x")))
    title = F.when(kind == 2, F.lit("Piim, FARMI, 1 l")).otherwise("piim")
    return t.part.select(F.col("p_partkey").alias("id"), names.guess_brand(F.when(kind == 0, F.col("p_brand")), F.lit(None).cast("string"), specs, title).alias("brand"))


@query("sf42_unit_price_text", "SELECT row_no, contains(price_text, '25') AS is_unit FROM scraped")
def _unit_price(t: Tables) -> DataFrame:
    return t.scraped.select("row_no", money.is_unit_price(F.replace("price_text", F.lit("25"), F.lit("25 €/kg"))).alias("is_unit"))


@query("sf44_pick_barcode", "SELECT id, CASE id % 3 WHEN 0 THEN ean WHEN 1 THEN concat('9', ean) ELSE concat('8', ean) END AS barcode FROM products")
def _barcode(t: Tables) -> DataFrame:
    kind = F.col("id") % 3
    gtins = F.when(kind == 0, F.create_map(F.lit("gtin"), F.col("ean"))).otherwise(F.create_map(F.lit("sku"), F.col("ean")))
    specs = F.when(kind == 1, F.create_map(F.lit("Ribakood (EAN)"), F.concat(F.lit("9"), F.col("ean")))).otherwise(F.create_map(F.lit("Muu"), F.lit("x")))
    image = F.concat(F.lit("https://x/8"), F.col("ean"), F.lit("_kuva1.webp"))
    return t.products.select("id", codes.pick_barcode(gtins, specs, image).alias("barcode"))


@query("pf12_plausible_product", """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS ok FROM part""")
def _plausible(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 6
    name = F.when(kind == 0, F.col("p_name")).when(kind == 1, "Cookie settings").when(kind == 2, "pant").when(kind == 3, F.lit("Piim 1 l")).when(kind == 4, F.col("p_name")).otherwise("leib")
    name = F.when(kind == 5, F.lit("Rukkileib")).otherwise(name)
    price = F.when(kind.isin(3, 5), 1.5)
    return t.part.select(F.col("p_partkey").alias("id"), names.plausible_product(name, price, F.when(kind == 0, "47400"), F.when(kind == 5, F.col("p_brand")), F.lit(None).cast("string")).alias("ok"))


@query("pf13_food_category", "SELECT page_id, regexp_matches(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '^/(en|fr)(/|$)') AND NOT contains(url, '/en/2') AS ok FROM pages")
def _food(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.select("page_id", files.food_category(path, ["/en", "/fr"], ["/en/2"]).alias("ok"))


# ---- files -------------------------------------------------------------------


@query("sc01_load_staging", "SELECT concat('s', row_no) AS ext_id, name, coalesce(brand, '') AS brand, TRY_CAST(nullif(replace(price_text, ',', '.'), '') AS DOUBLE) AS price, 'EUR' AS currency FROM scraped")
def _staging(t: Tables) -> DataFrame:
    raw = t.scraped.select(F.concat(F.lit("s"), F.col("row_no")).alias("id"), F.lit("").alias("ext_id"), F.col("name").alias("product_name"), "brand", F.col("price_text").alias("price"))
    return files.load_staging(raw).select("ext_id", "name", "brand", "price", "currency")


@query("sc02_ingest_csv", "SELECT row_no, trim(name) AS name, CAST(price AS DOUBLE) AS price, 'EUR' AS currency FROM scraped WHERE row_no % 5 <> 0")
def _ingest(t: Tables) -> DataFrame:
    raw = t.scraped.select("row_no", F.when(F.col("row_no") % 5 == 0, " ").otherwise(F.col("ext_id")).alias("ext_id"), "name", F.col("price").cast("string").alias("price"), F.lit("eur").alias("currency"))
    return files.ingest_csv(raw.withColumn("row_no", F.col("row_no").cast("string"))).select(F.col("row_no").cast("long").alias("row_no"), "name", "price", "currency")


@query("sc03_split_labels", """
WITH l AS (SELECT CASE WHEN doc_id % 5 = 0 THEN concat('x', doc_id) ELSE CAST(doc_id AS VARCHAR) END AS product_id, CASE WHEN quality = 1 THEN 'm' ELSE '' END AS m, CASE WHEN toxic = 0 THEN 's' ELSE '' END AS s FROM labels)
SELECT 'updates' AS kind, CAST(count(*) AS BIGINT) AS n FROM l WHERE product_id NOT LIKE 'x%' UNION ALL SELECT 'uncertain', CAST(count(*) AS BIGINT) FROM l WHERE m = '' OR s = ''""")
def _labels(t: Tables) -> DataFrame:
    raw = t.labels.select(
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("product_id"),
        F.when(F.col("quality") == 1, " m ").otherwise(" ").alias("canonical_main_code"), F.when(F.col("toxic") == 0, "s").alias("canonical_sub_code"),
    )
    parts = zip(("updates", "uncertain"), files.split_labels(raw, F.lit("labels.csv")))
    one, two = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in parts]
    return one.unionByName(two)


@query("sc04_price_sheet", "SELECT trim(name) AS product, CAST(price AS DOUBLE) AS price, 'Rimi Tartu' AS store_name FROM scraped")
def _sheet(t: Tables) -> DataFrame:
    raw = t.scraped.select(F.col("name").alias("Toode"), F.col("brand").alias("Tootja"), F.col("size_text").alias("Kogus"), F.col("price").alias("Hind (€)"))
    return files.load_price_sheet(raw, "rimi_tartu_tooted.xlsx")[0].select("product", "price", "store_name")


@query("sc06_category_urls", "SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS category_id FROM pages WHERE regexp_matches(url, '/[0-9]+')")
def _categories(t: Tables) -> DataFrame:
    lines = t.pages.select(F.concat(F.col("page_id"), F.lit(" -> https://x/smc/"), F.regexp_extract("url", "/([0-9]+)", 1)).alias("value"))
    rows = files.parse_category_urls(files.clean_lines(lines))
    return rows.select(F.col("name").cast("long").alias("page_id"), "category_id")


@query("sc07_skip_lists", "SELECT page_id FROM pages WHERE regexp_replace(url, '[?#].*$', '') NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 4 = 0) AND page_id NOT IN (7, 11)")
def _skips(t: Tables) -> DataFrame:
    lines = t.pages.filter("page_id % 4 = 0").select(F.col("url").alias("line")).unionByName(t.pages.filter("page_id IN (7, 11)").select(F.col("page_id").cast("string").alias("line")))
    return files.apply_skip_only(t.pages, lines, None, item_id="page_id").select("page_id")


@query("sc12_shard", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) x WHERE i % 7 = 3")
def _shard(t: Tables) -> DataFrame:
    return files.shard(t.orders.select("o_orderkey"), "o_orderkey", 7, 3)


@query("pf20_normalize_baskets", """
WITH i AS (SELECT l_orderkey AS basket_id, l_partkey, CASE WHEN l_quantity < 5 THEN 0.5E0 * l_quantity - 1 ELSE l_quantity END AS q, l_linenumber AS k FROM lineitem),
n AS (SELECT basket_id, l_partkey, CASE WHEN q = 0 THEN 1 ELSE q END AS q, k FROM i)
SELECT basket_id, l_partkey AS product_id, round(sum(greatest(q, 0.1)), 6) AS quantity FROM n WHERE q > 0 AND k % 3 <> 0 GROUP BY 1, 2""")
def _normalize(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    raw = t.lineitem.select(
        F.col("l_orderkey").alias("basket_id"), F.concat(F.lit(" p"), F.col("l_partkey")).alias("product"), F.col("l_partkey").alias("product_id"),
        F.when(q < 5, q * 0.5 - 1).otherwise(q).alias("quantity"), F.when(F.col("l_linenumber") % 3 == 0, "salt").otherwise(" ").alias("ingredient_name_en"),
    )
    return B.normalize_baskets(raw)[0].select("basket_id", "product_id", F.round("quantity", 6).alias("quantity"))


@query("pf20_oversized_baskets", "SELECT l_suppkey AS basket_id, CAST(count(*) AS BIGINT) AS items FROM lineitem GROUP BY 1 HAVING count(*) > 50")
def _oversized(t: Tables) -> DataFrame:
    return B.oversized_baskets(t.lineitem.select(F.col("l_suppkey").alias("basket_id")))


# ---- pages -------------------------------------------------------------------


def _shop_pages(t: Tables) -> DataFrame:
    """One page per product, in the shapes shops use, made of the part table.
    Products are dealt out before there are pages of them."""
    products = spread(t.products, t.rows("part"))
    quoted = lambda key, value: F.concat(F.lit(f'"{key}":"'), value.cast("string"), F.lit('"'))
    name, ean = F.col("name"), F.col("ean")
    euros = F.format_string("%.2f", F.col("list_price") / 100.0)
    jsonld = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Product",'), quoted("name", name), F.lit(","), quoted("gtin13", ean), F.lit(',"brand":{'), quoted("name", F.col("brand")),
        F.lit('},"offers":{'), quoted("price", euros), F.lit(',"priceCurrency":"EUR"},'), quoted("image", F.concat(F.lit("https://img.example/"), F.col("id"), F.lit(".jpg"))), F.lit("}</script>"),
        F.lit('<script type="application/ld+json">[{"@type":"BreadcrumbList","itemListElement":[{"name":"Pood"},{"item":{'), quoted("name", F.col("sub_code")), F.lit("}}]}]</script>"),
    )
    listed = F.concat(F.lit('<script>window.b_productList = [{"id":'), F.col("id"), F.lit(","), quoted("title", name), F.lit(',"price":'), euros, F.when(F.col("id") % 2 == 0, ',"retail_price":99.5').otherwise(""), F.lit("}]; var x = [1];</script>"))
    attribute = F.concat(F.lit("{&quot;id&quot;:&quot;"), F.col("id"), F.lit("&quot;,&quot;name&quot;:&quot;"), name, F.lit(" 500g&quot;,&quot;price&quot;:"), euros, F.lit("}"))
    card = F.concat(F.lit('<div class="card" data-gtm-eec-product="'), attribute, F.lit('"><span class="sr-only">'), F.when(F.col("id") % 2 == 0, F.lit("2.59 € per kg")).otherwise(""), F.lit("</span></div>"))
    shop = F.concat(F.lit('<li class="product post-'), F.col("id"), F.lit('"><a href="https://x/toode/'), F.col("id"), F.lit('/"><img src="//cdn/'), ean, F.lit('.jpg"><h2 class="product-title">'), name, F.lit('</h2></a><span class="price"><ins><span class="amount"><bdi>'), euros, F.lit(" €</bdi></span></ins></span></li>"))
    specs = F.concat(F.lit("<table><tr><th>Kaubamärk</th><td>"), F.replace("brand", F.lit("Brand#"), F.lit("Farm ")), F.lit("</td></tr></table><dl><dt>Netokogus</dt><dd>"), F.coalesce("size_text", F.lit("-")), F.lit("</dd></dl><p>Tootja: AS "), F.col("brand"), F.lit("</p>"))
    state = F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"apolloState":{"Product:'), F.col("id"), F.lit('":{"__typename":"Product",'), quoted("ean", ean), F.lit(","), quoted("name", name),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit(',"price":'), euros)).otherwise(""), F.lit('},"ProductStoreEdge:1":{"price":7.5,"product":{"__ref":"Product:'), F.col("id"), F.lit('"}}}}}}</script>'),
    )
    return products.select(F.col("id").alias("page_id"), F.concat(F.lit("<html>"), jsonld, listed, card, shop, specs, state, F.lit("</html>")).alias("html"))


EUROS = "list_price / 100.0::DOUBLE"


@query("sf20_extract_jsonld", f"SELECT id AS page_id, printf('%.2f', {EUROS}) AS price, ean AS gtin13, brand, name AS product_name, concat('Pood>', sub_code) AS crumbs FROM products")
def _jsonld(t: Tables) -> DataFrame:
    rows = web.extract_jsonld(_shop_pages(t))
    return rows.select("page_id", "price", "gtin13", "brand", "product_name", F.array_join("crumbs", ">").alias("crumbs"))


@query("sf21_deep_find", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events")
def _deep(t: Tables) -> DataFrame:
    return t.events.select("event_id", web.deep_find(F.concat(F.lit('{"a":[{"b":'), F.col("props"), F.lit("}]}")), ["K"])["k"].alias("k"))


@query("sf22_extract_next_data", f"SELECT id AS page_id, ean, name, round(CASE WHEN id % 2 = 0 THEN {EUROS} ELSE 7.5 END, 2) AS price FROM products")
def _next(t: Tables) -> DataFrame:
    return web.extract_next_data(_shop_pages(t)).select("page_id", "ean", "name", F.round("price", 2).alias("price"))


@query("sf23_extract_product_list", f"SELECT id AS page_id, CAST(id AS VARCHAR) AS sku, name, CASE WHEN id % 2 = 0 THEN 99.5::DOUBLE ELSE round({EUROS}, 2) END AS price, CASE WHEN id % 2 = 0 THEN round({EUROS}, 2) END AS promo_price FROM products")
def _listed(t: Tables) -> DataFrame:
    return web.extract_product_list(_shop_pages(t)).select("page_id", "sku", "name", "price", "promo_price")


@query("sf24_extract_cards", f"SELECT id AS page_id, CAST(id AS VARCHAR) AS ext_id, concat(name, ' 500g') AS name, '500 g' AS size_text, CASE WHEN id % 2 = 0 THEN 2.59::DOUBLE ELSE round({EUROS}, 2) END AS price FROM products")
def _cards(t: Tables) -> DataFrame:
    return web.extract_cards(_shop_pages(t)).select("page_id", "ext_id", "name", "size_text", "price")


@query("sf41_extract_shop_cards", f"SELECT id AS page_id, ean AS ext_id, name, round({EUROS}, 2) AS price, CAST(id AS VARCHAR) AS sku FROM products")
def _shop_cards(t: Tables) -> DataFrame:
    return web.extract_shop_cards(_shop_pages(t)).select("page_id", "ext_id", "name", F.col("price").cast("double").alias("price"), "sku")


@query("sf40_extract_specs", "SELECT id AS page_id, replace(brand, 'Brand#', 'Farm ') AS brand, concat('AS ', brand) AS manufacturer, coalesce(size_text, '-') AS size_text FROM products")
def _specs(t: Tables) -> DataFrame:
    return web.extract_specs(_shop_pages(t)).select("page_id", "brand", "manufacturer", "size_text")


@query("sf27_extract_image_url", "SELECT id AS page_id, concat('https://img.example/', id, '.jpg') AS image_url FROM products")
def _image(t: Tables) -> DataFrame:
    return _shop_pages(t).select("page_id", web.extract_image_url(F.col("html")).alias("image_url"))


@query("sf27_given_page_images", r"""
SELECT page_id, nullif(regexp_extract(html, '<meta[^>]+property=.og:image.[^>]+content=.(http[^"'']+)', 1), '') AS image_url,
  CAST(len(list_filter(list_transform(
    regexp_extract_all(html, '(?is)<(?:li|p|span|div)[^>]*>[^<:]{1,60}:[^<]{1,160}</(?:li|p|span|div)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')),
    lambda x: regexp_matches(x, '^[^:]*[^:\s][^:]*:\s*\S'))) AS INTEGER) AS labels FROM pages""")
def _given_images(t: Tables) -> DataFrame:
    return t.pages.select("page_id", web.extract_image_url(F.col("html")).alias("image_url"), F.size(web.label_pairs(F.col("html"))).alias("labels"))


def _bodies(t: Tables, kind: str) -> DataFrame:
    row = t.products.select(F.col("id").alias("payload_id"), "name", "brand", "ean", F.format_string("%.2f", F.col("list_price") / 100.0).alias("e"), (F.col("list_price") % 1000 + 101).alias("c"), "id")
    if kind == "search":
        body = F.concat(F.lit('{"hits":{"hits":[{"_source":{"sku":"'), F.col("id") % 700, F.lit('","name":"'), F.col("name"), F.lit('","prices":[{"customer_group_id":0,"final_price":'), F.col("e"), F.lit('},{"customer_group_id":1,"price":1.5,"is_discount":'), F.when(F.col("id") % 2 == 0, "true").otherwise("false"), F.lit("}]}}]}}"))
    elif kind == "dishes":
        body = F.concat(F.lit('{"data":{"items":{"k'), F.col("id"), F.lit('":{"type":"'), F.when(F.col("id") % 5 == 0, "menu").otherwise("dish"), F.lit('","product_id":"'), F.col("ean"), F.lit('","name":{"value":"'), F.col("name"), F.lit('"},"price":{"value":'), F.col("e"), F.lit("}}}}}"))
    elif kind == "category":
        body = F.concat(F.lit('{"category":{"name":"c"},"items":[{"id":"'), F.col("id"), F.lit('","name":"'), F.col("name"), F.lit('","price":'), F.col("c"), F.lit("}]}"))
    else:
        body = F.concat(F.lit('{"products":[{"product":{"id":"'), F.col("id") % 900, F.lit('","title":"'), F.col("name"), F.lit('","price":'), F.col("c"), F.lit("}}]}"))
    return row.select("payload_id", body.alias("body"))


@query("sf25_flatten_search_api", f"""
SELECT CAST(k AS VARCHAR) AS ext_id, name, price, promo_price FROM (SELECT id % 700 AS k, name, round({EUROS}, 2) AS price, CASE WHEN id % 2 = 0 THEN 1.5::DOUBLE END AS promo_price, row_number() OVER (PARTITION BY id % 700 ORDER BY id) AS r FROM products) x WHERE r = 1""")
def _search_api(t: Tables) -> DataFrame:
    return web.flatten_api(_bodies(t, "search"), "search").select("ext_id", "name", "price", "promo_price")


@query("sf25_flatten_dish_api", f"SELECT concat('k', id) AS item_id, name, ean, round({EUROS}, 2) AS price FROM products WHERE id % 5 <> 0")
def _dish_api(t: Tables) -> DataFrame:
    return web.flatten_api(_bodies(t, "dishes"), "dishes").select("item_id", "name", "ean", "price")


@query("sf25_flatten_category_api", "SELECT CAST(id AS VARCHAR) AS id, (list_price % 1000 + 101) / 100.0::DOUBLE AS price FROM products")
def _category_api(t: Tables) -> DataFrame:
    return web.flatten_api(_bodies(t, "category"), "category").select("id", "price")


@query("sf25_flatten_list_api", "SELECT CAST(k AS VARCHAR) AS ext_id, name, price FROM (SELECT id % 900 AS k, name, (list_price % 1000 + 101) / 100.0::DOUBLE AS price, row_number() OVER (PARTITION BY id % 900 ORDER BY id) AS r FROM products) x WHERE r = 1")
def _list_api(t: Tables) -> DataFrame:
    return web.flatten_api(_bodies(t, "list"), "list").select("ext_id", "name", "price")


@query("sf26_collect_items", "SELECT id AS payload_id, name FROM products")
def _collect(t: Tables) -> DataFrame:
    rows = _bodies(t, "category").select("payload_id", F.explode(web.collect_items(F.col("body"))).alias("item"))
    return rows.select("payload_id", F.get_json_object("item", "$.name").alias("name"))
