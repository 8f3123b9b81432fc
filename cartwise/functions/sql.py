"""SQL functions for users who write queries as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cartwise.functions import vocab


def _name_body() -> str:
    text = "lower(trim(BOTH ' \\t\\r\\n' FROM name))"
    for prefix in vocab.CHAIN_PREFIXES:
        text = f"regexp_replace({text}, r'(?iU){prefix}', '')"
    for _ in range(3):
        for ending in vocab.NAME_ENDINGS:
            text = f"trim(regexp_replace({text}, r'(?iU){ending}', ''))"
    return f"trim(regexp_replace({text}, r'\\s+', ' '))"


def _distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371 * asin(sqrt(pow(sin(radians(({lat2} - {lat1}) / 2)), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2} - {lon1}) / 2)), 2)))"
    )


def register(spark: SparkSession) -> None:
    """Make `haversine_km` and `normalize_product_name` callable from SQL in
    this session. They are SQL expressions, so the optimizer sees through
    them."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
        RETURN {_distance("lat1", "lon1", "lat2", "lon2")}
    """)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_product_name(name STRING) RETURNS STRING RETURN {_name_body()}")


def register_cheapest(spark: SparkSession, latest: str, stores: str) -> None:
    """Make the table function `cheapest_within(lat, lon, km)` callable from SQL
    in this session: the cheapest row of each product among the stores within
    `km` of a point. `latest` (product_id, store_id, price, collected_at) and
    `stores` (id, lat, lon) are names of views. With LATERAL it answers many
    points in one job."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION cheapest_within(at_lat DOUBLE, at_lon DOUBLE, km DOUBLE)
        RETURNS TABLE(product_id BIGINT, store_id BIGINT, price BIGINT, collected_at TIMESTAMP)
        RETURN SELECT best.product_id, best.row.store_id, best.row.price, best.row.collected_at FROM (
          SELECT l.product_id, min_by(
              struct(l.store_id, l.price, CAST(l.collected_at AS TIMESTAMP) AS collected_at),
              struct(l.price IS NULL, l.price, -coalesce(unix_micros(CAST(l.collected_at AS TIMESTAMP)), -4611686018427387904), l.store_id)) AS row
          FROM {latest} l JOIN {stores} s ON s.id = l.store_id
          WHERE s.lat IS NOT NULL AND s.lon IS NOT NULL AND {_distance("at_lat", "at_lon", "s.lat", "s.lon")} <= km
          GROUP BY l.product_id) best
    """)
