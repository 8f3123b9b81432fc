"""Distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance between two points given in degrees."""
    half_lat = F.pow(F.sin(F.radians((lat2 - lat1) / 2)), 2)
    half_lon = F.pow(F.sin(F.radians((lon2 - lon1) / 2)), 2)
    chord = half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(chord))


def lat_reach(radius_km: Column) -> Column:
    """Half height of the bounding box in degrees."""
    return radius_km / F.lit(KM_PER_DEGREE)


def lon_reach(radius_km: Column, lat: Column) -> Column:
    """Half width of the bounding box in degrees at a latitude."""
    return radius_km / (F.lit(KM_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))


def coords_from_url(url: Column) -> Column:
    """Latitude, longitude or free-text query held in a map link."""
    number = r"(-?\d+(?:\.\d+)?)"
    at = rf"/@{number},{number}"
    plain = F.try_url_decode(url)
    plain = F.coalesce(plain, url)
    pair = rf"[?&](?:destination|q|query)={number},\s*{number}"
    lat = F.coalesce(_found(url, at, 1), _found(plain, pair, 1)).try_cast("double")
    lon = F.coalesce(_found(url, at, 2), _found(plain, pair, 2)).try_cast("double")
    text = F.when(
        lat.isNull(),
        F.nullif(F.trim(F.regexp_extract(F.translate(plain, "+", " "), r"[?&](?:destination|q|query)=([^&]*)", 1)), F.lit("")),
    )
    return F.struct(lat.alias("lat"), lon.alias("lon"), text.alias("query"))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
