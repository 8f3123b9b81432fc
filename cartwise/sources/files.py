"""Loading and writing files: staging, labels, price sheets, lists, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.common import blank_to_null, positions

# Column names a staging file may use, in order of preference.
STAGING_COLUMNS = {
    "store_chain": ("store_chain", "chain"), "store_name": ("store_name",), "store_channel": ("store_channel", "channel"),
    "ext_id": ("ext_id", "id", "external_id"), "ean_raw": ("ean_raw", "ean"), "sku_raw": ("sku_raw", "sku"), "name": ("name", "product_name"),
    "size_text": ("size_text", "size"), "brand": ("brand", "manufacturer"), "manufacturer": ("manufacturer",), "price": ("price", "unit_price"),
    "currency": ("currency",), "image_url": ("image_url", "image"), "category_path": ("category_path", "category_full"),
    "category_leaf": ("category_leaf", "category"), "source_url": ("source_url", "url"),
}
STAGING_DEFAULTS = {"currency": "EUR", "price": None}
# Headings of a price sheet.
SHEET_COLUMNS = {"Toode": "product", "Tootja": "manufacturer", "Kogus": "amount", "Hind (€)": "price"}


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")


def to_number(column: Column) -> Column:
    return F.replace(F.trim(column), F.lit(","), F.lit(".")).try_cast("double")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; broken lines are kept with NULLs."""
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", False).csv(path)


def load_staging(df: DataFrame, columns: dict = STAGING_COLUMNS, defaults: dict = STAGING_DEFAULTS) -> DataFrame:
    """Staging rows with the standard columns: the first filled value of each
    alias, decimal commas read, an unreadable price NULL."""
    present = set(df.columns)

    def pick(target: str) -> Column:
        values = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns[target] if c in present]
        return F.coalesce(*values, F.lit(defaults.get(target, "")).cast("string"))

    return df.select(*[(to_number(pick(t)) if t == "price" else pick(t)).alias(t) for t in columns])


def ingest_csv(df: DataFrame) -> DataFrame:
    """Single-retailer rows: the needed columns must exist, rows with a blank
    in any of them are skipped, the currency is in capitals."""
    require(df, ["ext_id", "name", "price"])
    rows = df.select([F.trim(F.col(c)).alias(c) for c in df.columns])
    filled = reduce(lambda ok, c: ok & blank_to_null(c).isNotNull(), ["ext_id", "name", "price"], F.lit(True))
    currency = F.upper(F.coalesce(blank_to_null("currency"), F.lit("EUR"))) if "currency" in df.columns else F.lit("EUR")
    return rows.filter(filled).withColumns({"price": to_number(F.col("price")), "currency": currency}).filter("price IS NOT NULL")


def split_labels(df: DataFrame, file: Column) -> tuple[DataFrame, DataFrame]:
    """Label rows with a whole-number id, and the rows that lack a code."""
    tidy = df.withColumnRenamed("\ufeffproduct_id", "product_id")
    require(tidy, ["product_id", "canonical_main_code", "canonical_sub_code"])
    code = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    others = [c for c in tidy.columns if c not in ("canonical_main_code", "canonical_sub_code")]
    rows = tidy.select(*others, code("canonical_main_code"), code("canonical_sub_code")).withColumn("source_file", file)
    whole = F.when(F.trim("product_id").rlike(r"^[+-]?\d+$"), F.trim("product_id").try_cast("long"))
    updates = rows.select(
        whole.alias("product_id"), blank_to_null("canonical_main_code").alias("main_code"), blank_to_null("canonical_sub_code").alias("sub_code"), "source_file"
    ).filter("product_id IS NOT NULL")
    return updates, rows.filter("canonical_main_code = '' OR canonical_sub_code = ''")


def load_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label files of a folder, byte order marks tolerated, with the name of
    the file each row came from."""
    df = read_csv(spark, path)
    return split_labels(df.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)), F.col("_file"))


def store_from_file(name: str) -> str:
    """Store name in a sheet's file name."""
    return name.replace(".xlsx", "").replace("_tooted", "").replace("_", " ").title()


def load_price_sheet(df: DataFrame, file_name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a price sheet with the store of its file name, and one row with
    the counts that forbid loading it (both zero when it is fine)."""
    renamed = df.select([F.col(f"`{c}`").cast("string").alias(SHEET_COLUMNS.get(c, c)) for c in df.columns])
    require(renamed, list(SHEET_COLUMNS.values()))
    rows = renamed.select(
        *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("product", "manufacturer", "amount")], to_number(F.col("price")).alias("price"),
        F.lit(store_from_file(file_name)).alias("store_name"),
    )
    return rows, rows.agg(F.count_if(F.col("product") == "").alias("empty_products"), F.count_if(F.col("price").isNull()).alias("bad_prices"))


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Approved pairs of product ids of two chains."""
    rows = read_csv(spark, path, sep="\t")
    return rows.select([F.col(c).try_cast("long").alias(c) for c in rows.columns]).na.drop()


def load_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file without blanks and comments."""
    return clean_lines(spark.read.text(path))


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.trim(column).alias("line")).filter("line <> '' AND NOT startswith(line, '#')")


def parse_category_urls(lines: DataFrame) -> DataFrame:
    """Name and id of category lines: `name -> address`, or an address whose
    `categoryName` names it. Lines without an id are dropped."""
    arrow = F.col("line").contains("->")
    url = F.when(arrow, F.trim(F.regexp_replace("line", r"^.*?->", ""))).otherwise(F.col("line"))
    given = F.trim(F.substring_index("line", "->", 1))
    queried = F.translate(F.try_url_decode(F.regexp_extract("line", r"[?&]categoryName=([^&#]*)", 1)), "+", " ")
    name = F.when(arrow, given).otherwise(F.coalesce(F.nullif(queried, F.lit("")), F.lit("Unknown")))
    return lines.select(name.alias("name"), F.regexp_extract(url, r"/smc/(\d+)", 1).alias("category_id")).filter("category_id <> ''")


def apply_skip_only(rows: DataFrame, skip: DataFrame | None, only: DataFrame | None, url: str = "url", item_id: str = "ext_id") -> DataFrame:
    """Rows a skip list leaves, or only those an only list names. A list line
    is an address, compared without query and fragment and by the id in it, or
    a bare id."""
    bare = lambda c: F.regexp_replace(c, r"[?#].*$", "")
    keyed = rows.withColumns({"_url": bare(F.col(url)), "_id": F.coalesce(F.col(item_id).cast("string"), F.lit(""))})

    def keys(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        is_url = F.col("line").startswith("http")
        urls = lines.filter(is_url).select(bare(F.col("line")).alias("_url")).distinct()
        number = F.coalesce(F.nullif(F.regexp_extract("line", r"/p/(\d+)", 1), F.lit("")), F.when(~is_url, F.col("line")))
        return urls, lines.select(number.alias("_id")).filter("_id IS NOT NULL").distinct()

    if only is not None:
        urls, ids = keys(only)
        hit = keyed.join(urls.withColumn("_u", F.lit(1)), "_url", "left").join(ids.withColumn("_i", F.lit(1)), "_id", "left")
        keyed = hit.filter("_u IS NOT NULL OR _i IS NOT NULL").drop("_u", "_i")
    if skip is not None:
        urls, ids = keys(skip)
        keyed = keyed.join(urls, "_url", "left_anti").join(ids, "_id", "left_anti")
    return keyed.drop("_url", "_id")


def shard(df: DataFrame, order: str, shards: int, index: int) -> DataFrame:
    """Rows whose place in the order of a unique numeric column falls on one
    of `shards` shares, dealt out in turn."""
    return positions(df, order, "_place").filter(F.col("_place") % shards == index).drop("_place")


def export_csv(df: DataFrame, path: str, columns: list[str], newest: str | None = None, sep: str = ",", bom: bool = False) -> None:
    """Write rows as CSV files with headings, newest first when asked. With
    `bom` the heading of every file starts with a byte order mark, as
    spreadsheet programs expect."""
    rows = df.orderBy(F.col(newest).desc_nulls_last()) if newest else df
    rows = rows.select(*columns)
    if bom:
        rows = rows.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    rows.write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)


def write_decisions(df: DataFrame, path: str) -> None:
    """Decisions with their trace as JSON lines."""
    df.write.mode("errorifexists").json(path)


def food_category(path: Column, allowed: list[str], banned: list[str]) -> Column:
    """Category paths under an allowed one and without a banned word."""
    low = F.lower(F.trim(path))
    low = F.when(low.startswith("/"), low).otherwise(F.concat(F.lit("/"), low))
    inside = reduce(lambda ok, a: ok | (low == a) | low.startswith(a + "/"), allowed, F.lit(not allowed))
    return inside & ~reduce(lambda hit, b: hit | low.contains(b), banned, F.lit(False))


def product_url(path: Column, banned: list[str]) -> Column:
    """Paths that hold none of the words of pages without a product."""
    low = F.lower(path)
    return ~reduce(lambda hit, b: hit | low.contains(b), banned, F.lit(False))
