"""The given tables seen as this domain.

Each view is one SQL text that both Spark and the checking database read the
same way. Money is whole cents, so sums agree exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.common import dealt

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

PRICE_AS_OF = "2001-11-05 00:00:00"
EVENT_AS_OF = "2024-01-30 12:00:00"

VIEWS: dict[str, str] = {}

# Five regions play the five chains, every tenth supplier is an online shop and
# some stores have no coordinates.
VIEWS["stores"] = """
SELECT s.s_suppkey AS id, s.s_name AS name, lower(r.r_name) AS chain,
       (s.s_suppkey % 10 = 0) AS is_online,
       CASE WHEN s.s_suppkey % 17 = 3 THEN NULL ELSE 58.0E0 + CAST((s.s_suppkey * 37) % 100 AS DOUBLE) / 100.0E0 END AS lat,
       CASE WHEN s.s_suppkey % 17 = 3 THEN NULL ELSE 24.0E0 + CAST((s.s_suppkey * 53) % 200 AS DOUBLE) / 100.0E0 END AS lon
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
"""

VIEWS["store_price_source"] = """
SELECT p.id AS store_id, o.source_store_id
FROM stores p JOIN (SELECT chain, min(id) AS source_store_id FROM stores WHERE is_online GROUP BY chain) o
  ON o.chain = p.chain
WHERE NOT p.is_online AND p.id % 3 <> 0
"""

VIEWS["products"] = """
SELECT p_partkey AS id, p_name AS name, p_brand AS brand, concat('sub_', lower(p_type)) AS sub_code,
       CASE p_partkey % 5 WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' WHEN 3 THEN 'europe' ELSE 'middle east' END AS chain,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size * 20 AS BIGINT) END AS net_qty,
       CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'ml' WHEN p_partkey % 29 = 0 THEN 'pack' ELSE 'g' END AS net_unit,
       CAST(CASE WHEN p_partkey % 7 = 0 THEN 4 ELSE 1 END AS BIGINT) AS pack_count,
       lpad(CAST(4740000000000 + p_partkey AS STRING), 13, '0') AS ean,
       CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 9 = 0 THEN '' ELSE concat('https://img.example/', CAST(p_partkey AS STRING), '.jpg') END AS image_url,
       CASE p_partkey % 8 WHEN 0 THEN 'https://www.prismamarket.ee/p/1' WHEN 1 THEN 'https://www.selver.ee/x' WHEN 2 THEN 'https://www.rimi.ee/x'
            WHEN 3 THEN 'https://barbora.ee/x' WHEN 4 THEN 'https://wolt.com/coop/x' WHEN 5 THEN 'https://ecoop.ee/x' WHEN 6 THEN NULL ELSE 'https://other.example/x' END AS source_url,
       CASE WHEN p_partkey % 11 = 0 THEN 'kg' WHEN p_partkey % 3 = 0 THEN NULL ELSE concat(CAST(p_size * 20 AS STRING), ' g') END AS size_text,
       CAST(floor(p_retailprice * 100 + 0.5E0) AS BIGINT) AS list_price
FROM part
"""

# Same name and category make one cross-chain group; its id is the lowest member.
VIEWS["product_group_members"] = """
SELECT min(p_partkey) OVER (PARTITION BY p_name, p_type) AS group_id, p_partkey AS product_id FROM part WHERE p_partkey % 19 <> 4
"""

VIEWS["product_groups"] = """
SELECT m.group_id AS id, min(p.name) AS canonical_name, min(p.sub_code) AS sub_code, min(p.brand) AS brand
FROM product_group_members m JOIN products p ON p.id = m.product_id GROUP BY m.group_id
"""

# Unit price per order line; a discount of 8 percent or more acts as a promo.
VIEWS["prices"] = """
SELECT l_partkey AS product_id, l_suppkey AS store_id,
       CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS price,
       CASE WHEN l_discount >= 0.08E0 THEN CAST(floor(l_extendedprice * 90 / l_quantity) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS promo_price,
       CASE WHEN l_tax = 0.08E0 THEN NULL ELSE l_shipdate END AS collected_at,
       l_shipdate AS seen_at,
       concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(CAST(floor(l_extendedprice * 100 + 0.5E0) AS BIGINT) AS STRING), l_returnflag) AS price_id
FROM lineitem
"""

VIEWS["baskets"] = """
SELECT o.o_orderkey AS basket_id, o.o_custkey AS user_id, l.l_partkey AS product_id,
       CAST(sum(l.l_quantity) AS BIGINT) AS quantity
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_custkey, l.l_partkey
"""

# A basket is priced from where its owner lives.
VIEWS["basket_origins"] = """
SELECT o_orderkey AS basket_id, 58.0E0 + CAST((o_custkey * 7) % 100 AS DOUBLE) / 100.0E0 AS lat,
       24.0E0 + CAST((o_custkey * 13) % 200 AS DOUBLE) / 100.0E0 AS lon
FROM orders
"""

VIEWS["analytics_events"] = """
SELECT event_id, ts AS created_at,
       CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'basket_add' WHEN 'purchase' THEN 'basket_win' ELSE event_type END AS event_type,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS product_id,
       CASE user_id % 5 WHEN 0 THEN 'africa' WHEN 1 THEN 'America' WHEN 2 THEN 'asia' WHEN 3 THEN 'Europe' ELSE 'middle east' END AS chain,
       CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('d', CAST(user_id AS STRING)) END AS device_key,
       user_id, value
FROM events
"""

VIEWS["categories"] = """
SELECT r.r_regionkey AS main_id, r.r_name AS main_label, n.n_nationkey AS sub_id, n.n_name AS sub_label
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
"""

# Which nation-category a product counts in.
VIEWS["product_categories"] = """
SELECT p_partkey AS product_id, CAST(p_partkey % 23 AS INT) AS sub_id FROM part
"""

# Raw catalogue rows with the spellings the cleaning functions meet.
VIEWS["scraped"] = """
SELECT p_partkey AS row_no, concat('x', CAST(p_partkey % 1500 AS STRING)) AS ext_id,
       concat(CASE p_partkey % 6 WHEN 0 THEN 'Coop ' WHEN 1 THEN 'Rimi ' WHEN 2 THEN 'Selver  ' WHEN 3 THEN '' WHEN 4 THEN 'prisma ' ELSE ' ' END,
              p_name,
              CASE CAST(floor(p_partkey / 6) AS BIGINT) % 13 WHEN 0 THEN ' 4x120g' WHEN 1 THEN ' 500 g' WHEN 2 THEN ' 1,5 L' WHEN 3 THEN ' 10 X 12 5 G'
                   WHEN 4 THEN ' kg' WHEN 5 THEN ' 5 g' WHEN 6 THEN ' 10 g' WHEN 7 THEN '' WHEN 8 THEN ' 2 kg'
                   WHEN 9 THEN ' 1 kl., kg' WHEN 10 THEN ' II klass' WHEN 11 THEN ', kg' ELSE ' 0.33 l pakitud karp' END) AS name,
       CASE p_partkey % 7 WHEN 0 THEN '6 x 0,33 l' WHEN 1 THEN '500 g' WHEN 2 THEN 'kg' WHEN 3 THEN 'abc' WHEN 4 THEN NULL WHEN 5 THEN '1.5 L' ELSE '3x200g' END AS size_text,
       CASE p_partkey % 8 WHEN 0 THEN concat(CAST(p_size AS STRING), '€49') WHEN 1 THEN concat(CAST(p_size AS STRING), ' 99') WHEN 2 THEN concat(CAST(p_size AS STRING), ',5')
            WHEN 3 THEN concat(CAST(p_size AS STRING), '%') WHEN 4 THEN concat('3', CAST(p_size + 10 AS STRING)) WHEN 5 THEN '49' WHEN 6 THEN '' ELSE concat(CAST(p_size AS STRING), '.25 €') END AS price_text,
       CASE p_partkey % 9 WHEN 0 THEN '-' WHEN 1 THEN NULL WHEN 2 THEN concat('474-', lpad(CAST(p_partkey AS STRING), 10, '0'))
            WHEN 3 THEN lpad(CAST(40000000000 + p_partkey AS STRING), 12, '0') WHEN 4 THEN concat('0', CAST(4740000000000 + p_partkey AS STRING))
            WHEN 5 THEN concat('1', CAST(4740000000000 + p_partkey AS STRING)) WHEN 6 THEN '11111111' WHEN 7 THEN CAST(4740000000000 + p_partkey AS STRING)
            ELSE CAST(40000000 + p_partkey AS STRING) END AS ean_raw,
       CASE p_partkey % 6 WHEN 0 THEN concat('Tootja: ', replace(p_brand, 'Brand#', 'Farm ')) WHEN 1 THEN 'Määramata' WHEN 2 THEN 'x' WHEN 3 THEN '12345' WHEN 4 THEN concat('brand - ', replace(p_brand, 'Brand#', 'Farm ')) ELSE replace(p_brand, 'Brand#', 'Farm ') END AS brand_raw,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(' ', p_brand, ' ') END AS brand,
       CASE p_partkey % 4 WHEN 0 THEN concat('https://www.selver.ee/e-selver/item-', CAST(p_partkey AS STRING), '?utm=1#top') WHEN 1 THEN concat('https://shop.rimi.ee/p/', CAST(p_partkey AS STRING), '/')
            WHEN 2 THEN concat('https://evil.example/p/', CAST(p_partkey AS STRING)) ELSE concat('https://www.selver.ee/toode/', CAST(p_partkey AS STRING), ':12:3') END AS url,
       CASE p_partkey % 5 WHEN 0 THEN 'selver.ee' WHEN 1 THEN 'coop.ee' WHEN 2 THEN 'rimi.ee' WHEN 3 THEN 'coop.ee' ELSE 'selver.ee' END AS store_host,
       CAST(floor(p_retailprice * 100 + 0.5E0) AS BIGINT) - (p_partkey * 31) % 700 AS price,
       p_type AS category
FROM part
"""

# The substitution domain: branded groups with grocery words in their names.
VIEWS["shelf_products"] = """
SELECT p_partkey AS id,
       concat(p_name, CASE p_partkey % 16 WHEN 0 THEN ' piim laktoosivaba 2,5%' WHEN 1 THEN ' maasika' WHEN 2 THEN ' metsmaasika vegan' WHEN 3 THEN ' 3,5%'
              WHEN 4 THEN ' veise hakkliha' WHEN 5 THEN ' broileri filee' WHEN 6 THEN ' gouda viil' WHEN 7 THEN ' viski mozzarella' WHEN 8 THEN ' ekstra neitsi'
              WHEN 9 THEN ' gluteenivaba' WHEN 10 THEN ' banaani' WHEN 11 THEN ' kreeka 10%' WHEN 12 THEN ' sea-veise 20%' WHEN 13 THEN ' light' ELSE '' END) AS name,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size * 20 AS BIGINT) END AS net_qty,
       CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'ml' WHEN p_partkey % 29 = 0 THEN 'pack' ELSE 'g' END AS net_unit,
       CAST(CASE WHEN p_partkey % 7 = 0 THEN 4 ELSE 1 END AS BIGINT) AS pack_count
FROM part
"""
VIEWS["shelf_members"] = """
SELECT min(p_partkey) OVER (PARTITION BY p_name, p_type, p_brand) AS group_id, p_partkey AS product_id FROM part
"""
VIEWS["shelf_groups"] = """
SELECT min(p_partkey) AS id, p_name AS canonical_name, p_brand AS brand,
       CASE p_type WHEN 'ECONOMY' THEN 'dairy_milk' WHEN 'STANDARD' THEN 'dairy_yogurt_kefir' WHEN 'PROMO' THEN 'cheese_regular'
            WHEN 'SMALL' THEN 'tea' WHEN 'MEDIUM' THEN 'baby_other' WHEN 'LARGE' THEN 'oils_olive' ELSE 'unruled' END AS sub_code
FROM part GROUP BY p_name, p_type, p_brand
"""
VIEWS["shelf_prices"] = """
SELECT product_id, (SELECT min(s_suppkey) FROM supplier) + (product_id * 7 + store_id % 3) % (SELECT count(*) FROM supplier) AS store_id,
       price, promo_price, seen_at, price_id FROM prices
"""

_WORD = re.compile(r"\b[a-z_]+\b")


def needed(sql: str) -> list[str]:
    """Adapter views a statement uses, each after the views it stands on."""
    found: list[str] = []

    def visit(text: str) -> None:
        used = set(_WORD.findall(text))
        for name in VIEWS:
            if name in used and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """`sql` as one statement over the given tables."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in needed(sql)]
    if not parts:
        return sql
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql


class Tables:
    """Adapter views and given tables of one data directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        self._rows: dict[str, int] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Number of rows of a given table."""
        if name not in self._rows:
            self._rows[name] = self.raw(name).count()
        return self._rows[name]

    @property
    def baskets(self) -> DataFrame:
        """The view of this name, order lines dealt out by their number first,
        so that no task sums up more of them on larger tables."""
        return self._basket_lines(self.raw("lineitem")).select("basket_id", "user_id", "product_id", "quantity")

    def keyed_baskets(self, keys: DataFrame) -> DataFrame:
        """Baskets with the columns of `keys` (product_id, …) that a line's
        product has. The lines meet them before they are dealt out by basket,
        and stay with their basket afterwards. Rows of `keys` that come twice
        give a line twice."""
        more = [c for c in keys.columns if c != "product_id"]
        once = keys.withColumnRenamed("product_id", "l_partkey").groupBy("l_partkey", *more).agg(F.count("*").alias("_copies"))
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(once, "l_partkey", "left")
        rows = self._basket_lines(lines, *more, "_copies")
        return rows.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)).cast("int")))).drop("_copies")

    def _basket_lines(self, lines: DataFrame, *more: str) -> DataFrame:
        count = self.rows("lineitem")
        orders = self.raw("orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_custkey").alias("user_id"))
        lines = lines.select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id"), "l_quantity", *more)
        return dealt(lines, count, "basket_id").join(orders, "basket_id").groupBy("basket_id", "user_id", "product_id", *more).agg(
            F.sum("l_quantity").cast("bigint").alias("quantity")
        )

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in RAW:
            return self.raw(name)
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run adapter SQL; the given tables enter as parquet scans."""
        statement = with_views(text)
        scans = [
            f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)"
            for t in RAW
            if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", statement)
        ]
        body = statement.lstrip()
        body = ",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body
        return self.spark.sql("WITH " + ",\n".join(scans) + body)
