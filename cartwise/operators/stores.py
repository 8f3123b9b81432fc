"""Stores: who is near, which store feeds whose prices, store upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.common import Keys, blank_to_null, names, pick_first, top_n
from cartwise.functions.geo import KM_PER_DEGREE, haversine_km, lat_reach, lon_reach


def physical_stores(stores: DataFrame) -> DataFrame:
    """Walk-in stores with coordinates."""
    online = F.coalesce(F.col("is_online"), F.lit(False))
    return stores.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~online)


def stores_missing_geo(stores: DataFrame) -> DataFrame:
    """Stores whose latitude or longitude is missing or zero."""
    lacking = [F.coalesce(F.col(c), F.lit(0.0)) == 0 for c in ("lat", "lon")]
    return stores.filter(lacking[0] | lacking[1])


def _band(lat: Column, radius_km: float) -> Column:
    return F.floor(lat * F.lit(KM_PER_DEGREE / radius_km)).cast("long")


def _columns_in_band(band: Column, radius_km: float) -> Column:
    """How many longitude cells circle the earth in a latitude band, each wide
    enough that points within the radius sit in the same or adjacent cells."""
    degrees = radius_km / KM_PER_DEGREE
    edge = F.least(F.greatest(F.abs((band - 1) * degrees), F.abs((band + 2) * degrees)), F.lit(90.0))
    width = F.lit(1.02 * degrees) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6))
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")


def _cell(lon: Column, columns: Column) -> Column:
    return F.floor(F.pmod(lon, F.lit(360.0)) * columns / 360.0).cast("long")


def home_cell(df: DataFrame, lat: str, lon: str, radius_km: float) -> DataFrame:
    """`df` with the grid cell of its point (_band, _cell)."""
    placed = df.withColumn("_band", _band(F.col(lat), radius_km))
    return placed.withColumn("_cell", _cell(F.col(lon), _columns_in_band(F.col("_band"), radius_km)))


def cells_around(df: DataFrame, lat: str, lon: str, radius_km: float) -> DataFrame:
    """`df` once for each grid cell that has points within the radius of its
    own: that of the point and its neighbours."""
    bands = df.withColumn("_band", F.explode(F.array(*[_band(F.col(lat), radius_km) + d for d in (-1, 0, 1)])))
    bands = bands.withColumn("_columns", _columns_in_band(F.col("_band"), radius_km))
    home = _cell(F.col(lon), F.col("_columns"))
    around = F.array_distinct(F.array(*[F.pmod(home + d, F.col("_columns")) for d in (-1, 0, 1)]))
    return bands.withColumn("_cell", F.explode(around)).drop("_columns")


def stores_within(
    origins: DataFrame, stores: DataFrame, radius_km: float, limit: int | None = None, origin_id: str = "origin_id",
    digits: int | None = None,
) -> DataFrame:
    """Physical stores within a radius of every origin.

    A store can only match origins in its own or a neighbouring grid cell, so
    the distance test runs behind an equi-join on the cell and not on every
    pair. Origins that share a point are matched once. `limit` keeps the
    nearest stores per origin, the store cap of a comparison request; `digits`
    rounds the distances, once for all origins of a point.
    """
    near = _spots_within(origins, stores, radius_km)
    if limit is not None:
        near = top_n(near, ["lat", "lon"], limit, *[F.col(c).asc_nulls_last() for c in ("distance_km", "chain", "store_name", "store_id")])
    if digits is not None:
        near = near.withColumn("distance_km", F.round("distance_km", digits))
    return origins.select(origin_id, "lat", "lon").join(near, ["lat", "lon"]).drop("lat", "lon")


def _spots_within(origins: DataFrame, stores: DataFrame, radius_km: float) -> DataFrame:
    """Physical stores within a radius of every point that origins have."""
    spots = origins.select("lat", "lon").distinct().filter("lat IS NOT NULL AND lon IS NOT NULL")
    cells = cells_around(spots, "lat", "lon", radius_km)
    shops = physical_stores(stores).select(
        F.col("id").alias("store_id"), F.col("name").alias("store_name"), "chain",
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
    )
    shops = home_cell(shops, "_lat", "_lon", radius_km)
    return (
        cells.join(shops, ["_band", "_cell"])
        .withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
        .filter(F.col("distance_km") <= radius_km)
        .select("lat", "lon", "store_id", "store_name", "chain", "distance_km")
    )


def within_pairs(pairs: DataFrame, origins: DataFrame, stores: DataFrame, radius_km: float, origin_id: str = "origin_id") -> DataFrame:
    """The rows of `stores_within` for pairs (origin_id, store_id) alone."""
    shops = physical_stores(stores).select(
        F.col("id").alias("store_id"), F.col("name").alias("store_name"), "chain", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")
    )
    asked = pairs.select(origin_id, "store_id").distinct()
    met = asked.join(origins.select(origin_id, "lat", "lon"), origin_id).join(shops, "store_id")
    met = met.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    return met.filter(F.col("distance_km") <= radius_km).select(origin_id, "store_id", "store_name", "chain", "distance_km")


#: Grids of halved width that `nearest_stores` lays over the radius.
LEVELS = 7
#: Kilometres of a degree, rounded up, and the latitude beyond which cells aren't halved.
DEGREE_KM, POLAR = 111.2, 80.0


def _cells_at(level: int, lat: Column, lon: Column, radius_km: float) -> Column:
    """Level, band, cell and the number of cells in the band."""
    width = radius_km / 2**level
    band = _band(lat, width)
    columns = _columns_in_band(band, width)
    return F.struct(F.lit(level).alias("level"), band.alias("band"), _cell(lon, columns).alias("cell"), columns.alias("columns"))


def _reach(at: Column, lat: Column, radius_km: float) -> Column:
    """No point of a cell is further from another one of it: along the meridian
    and then along the longest parallel."""
    height = F.lit(radius_km / KM_PER_DEGREE) / F.pow(F.lit(2.0), at["level"])
    widest = F.cos(F.radians(F.least(F.abs(at["band"] * height), F.abs((at["band"] + 1) * height))))
    return F.lit(DEGREE_KM) * (height + F.lit(360.0) / at["columns"] * F.when(F.abs(lat) < height, 1.0).otherwise(widest))


def nearest_stores(origins: DataFrame, stores: DataFrame, radius_km: float, origin_id: str = "origin_id") -> DataFrame:
    """For each origin (origin_id, lat, lon, wanted, skip) the `wanted` nearest
    physical stores within the radius, after the first `skip`, with their
    `position`; an origin without a position gets stores by id, and no distance.

    Cells are halved as long as one holds as many stores as its origins need:
    the stores of an origin's smallest such cell lie within that cell's reach, so
    none further away can be among the nearest. An origin joins cells that are
    as wide as its own reach, and reads no more than the ring around it; only
    where stores are few it searches the whole radius.
    """
    need = F.greatest(F.coalesce("wanted", F.lit(0)) + F.coalesce("skip", F.lit(0)), F.lit(1))
    placed = origins.filter("lat IS NOT NULL AND lon IS NOT NULL")
    spots = placed.groupBy("lat", "lon").agg(F.max(need).alias("need"))
    shops = physical_stores(stores).select(
        F.col("id").alias("store_id"), F.col("name").alias("store_name"), "chain", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")
    )
    at = lambda lat, lon: F.array(*[_cells_at(k, F.col(lat), F.col(lon), radius_km) for k in range(LEVELS)])
    shelves = shops.select("*", F.explode(at("_lat", "_lon")).alias("_at"))
    cell = ["level", "band", "cell"]
    crowds = shelves.groupBy(*[F.col(f"_at.{c}").alias(c) for c in cell]).agg(F.count("*").alias("stores"))
    own = spots.select("*", F.explode(at("lat", "lon")).alias("_at")).filter(F.abs("lat") < POLAR)
    own = own.select("lat", "lon", "need", "_at.*", _reach(F.col("_at"), F.col("lat"), radius_km).alias("reach"))
    sure = own.join(crowds, cell).filter(F.col("stores") >= F.col("need")).groupBy("lat", "lon").agg(F.min("reach").alias("reach"))
    spots = spots.join(sure, ["lat", "lon"], "left").withColumn("reach", F.least(F.coalesce("reach", F.lit(radius_km)), F.lit(radius_km)))
    # the narrowest grid whose cells are as wide as the reach
    level = F.least(F.floor(F.log2(F.lit(radius_km) / F.col("reach"))), F.lit(LEVELS - 1)).cast("int")
    rings = spots.withColumn("level", level).select("lat", "lon", "reach", "level", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_up"))
    cells = None
    for k in range(LEVELS):
        width = radius_km / 2**k
        ring = rings.filter(F.col("level") == k).withColumn("band", _band(F.col("lat"), width) + F.col("_up"))
        columns = _columns_in_band(F.col("band"), width)
        home = _cell(F.col("lon"), columns)
        around = F.array_distinct(F.array(*[F.pmod(home + d, columns) for d in (-1, 0, 1)]))
        ring = ring.select("lat", "lon", "reach", "level", "band", F.explode(around).alias("cell"))
        cells = ring if cells is None else cells.unionByName(ring)
    shelves = shelves.select("store_id", "store_name", "chain", "_lat", "_lon", *[F.col(f"_at.{c}").alias(c) for c in cell])
    met = cells.join(shelves, cell).withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    met = met.filter(F.col("distance_km") <= F.col("reach")).select("lat", "lon", "store_id", "store_name", "chain", "distance_km")
    order = [F.col(c).asc_nulls_last() for c in ("distance_km", "chain", "store_name", "store_id")]
    ranked = met.withColumn("_place", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(*order)))
    kept = (F.col("_place") > F.coalesce("skip", F.lit(0))) & (F.col("_place") <= F.coalesce("skip", F.lit(0)) + F.coalesce("wanted", F.lit(0)))
    asked = placed.select(origin_id, "lat", "lon", "wanted", "skip")
    near = asked.join(ranked, ["lat", "lon"]).filter(kept)
    asking = origins.filter("lat IS NULL OR lon IS NULL").select(origin_id, F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("skip", F.lit(0)).alias("skip"))
    asking = asking.filter("wanted > 0").withColumn("_place", F.explode(F.sequence(F.col("skip") + 1, F.col("skip") + F.col("wanted")).cast("array<int>")))
    everywhere = asking.join(stores_everywhere(stores, asking), "_place")
    fields = [origin_id, "store_id", "store_name", "chain", "distance_km", (F.col("_place") - F.coalesce("skip", F.lit(0))).cast("int").alias("position")]
    return near.select(*fields).unionByName(everywhere.select(*fields))


def stores_everywhere(stores: DataFrame, asking: DataFrame) -> DataFrame:
    """Physical stores by id, no distance, as far as any of the requests
    `asking` (wanted, skip) reads them, with their place."""
    furthest = asking.agg(F.max(F.col("wanted") + F.col("skip"))).first()[0] or 0
    listed = physical_stores(stores).select(
        F.col("id").alias("store_id"), F.col("name").alias("store_name"), "chain", F.lit(None).cast("double").alias("distance_km")
    ).orderBy("store_id").limit(furthest)
    return listed.withColumn("_place", F.row_number().over(Window.orderBy("store_id")))  # at most `furthest` rows


def within_box(stores: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Bounding-box shortlist around one point with rounded distances; a plain
    range predicate that reaches the scan."""
    here = (F.lit(float(lat)), F.lit(float(lon)))
    dlat, dlon = lat_reach(F.lit(radius_km)), lon_reach(F.lit(radius_km), here[0])
    boxed = stores.filter(
        F.col("lat").between(here[0] - dlat, here[0] + dlat) & F.col("lon").between(here[1] - dlon, here[1] + dlon)
    )
    distance = haversine_km(*here, F.col("lat"), F.col("lon"))
    return boxed.withColumn("distance_km", distance).filter(F.col("distance_km") <= radius_km).withColumn(
        "distance_km", F.round("distance_km", 2)
    )


def chains_within(
    origins: DataFrame, stores: DataFrame, radius_km: float, origin_id: str = "origin_id", merge: dict[str, str] | None = None
) -> DataFrame:
    """`nearby_chains` of the stores within a radius, folded to chains at each
    point before the origins of the point are looked up."""
    chains = nearby_chains(_spots_within(origins, stores, radius_km), ["lat", "lon"], merge)
    near = origins.select(origin_id, "lat", "lon").join(chains, ["lat", "lon"])
    return near.groupBy(origin_id, "chain").agg(F.min("min_distance_km").alias("min_distance_km"))


def nearby_chains(near: DataFrame, origin_id: Keys = "origin_id", merge: dict[str, str] | None = None) -> DataFrame:
    """Shortest way to each chain per origin, two decimals; `merge` renames
    chains that share their stores."""
    chain = F.lower("chain")
    for old, new in (merge or {}).items():
        chain = F.when(chain == old, F.lit(new)).otherwise(chain)
    return (
        near.filter(F.col("chain").isNotNull())
        .groupBy(*names(origin_id), chain.alias("chain"))
        .agg(F.round(F.min("distance_km"), 2).alias("min_distance_km"))
    )


def effective_source(stores: DataFrame, source_map: DataFrame) -> DataFrame:
    """The store whose rows price each store: its mapped source (the lowest if
    several), else itself."""
    lowest = source_map.groupBy("store_id").agg(F.min("source_store_id").alias("_source"))
    return stores.select(F.col("id").alias("store_id")).join(lowest, "store_id", "left").select(
        "store_id", F.coalesce("_source", "store_id").alias("source_store_id")
    )


def build_price_source_map(stores: DataFrame, existing: DataFrame) -> DataFrame:
    """New map rows: every unmapped physical store points at the lowest online
    store of its chain."""
    online = F.coalesce(F.col("is_online"), F.lit(False))
    sources = stores.filter(online).groupBy("chain").agg(F.min("id").alias("source_store_id"))
    unmapped = stores.filter(~online).select(F.col("id").alias("store_id"), "chain").join(existing, "store_id", "left_anti")
    return unmapped.join(sources, "chain").select("store_id", "source_store_id")


def venue_stores(venues: DataFrame, stores: DataFrame) -> DataFrame:
    """Marketplace venues with the store that carries their key."""
    keyed = stores.filter(blank_to_null("external_key").isNotNull()).groupBy("external_key").agg(F.min("id").alias("store_id"))
    return venues.join(keyed, venues["venue_id"] == keyed["external_key"], "left").drop("external_key")


def dedupe_stores(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row per whitespace-normal name and address; the first arrival wins
    unless only a later one knows the coordinates."""
    tidy = rows
    for column in ("name", "address"):
        tidy = tidy.withColumn(column, F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " ")))
    unplaced = (F.col("lat").isNull() | F.col("lon").isNull()).cast("int")
    return pick_first(tidy, ["name", "address"], unplaced.asc(), F.col(arrival).asc())


def upsert_stores(stores: DataFrame, incoming: DataFrame, online_chains: list[str] | None = None) -> DataFrame:
    """Insert unknown stores and fill only the gaps of known ones; the key is
    (chain, name). Chains without an online store get one when asked.

    `incoming` needs unique keys. New rows carry a NULL id for the sink to fill.
    """
    fills = ["address", "lat", "lon"]
    new = incoming.select("chain", "name", *[F.col(c).alias(f"_{c}") for c in fills], F.col("is_online").alias("_online"))
    merged = stores.join(new, ["chain", "name"], "full_outer").select(
        "id", "name", "chain",
        F.coalesce("lat", "_lat").alias("lat"), F.coalesce("lon", "_lon").alias("lon"),
        F.coalesce("is_online", "_online", F.lit(False)).alias("is_online"),
        F.coalesce(blank_to_null("address"), "_address").alias("address"),
    )
    if not online_chains:
        return merged
    spark = stores.sparkSession
    wanted = spark.createDataFrame([(c,) for c in online_chains], "chain string")
    missing = wanted.join(merged.filter("is_online"), "chain", "left_anti").select(
        F.lit(None).cast(merged.schema["id"].dataType).alias("id"),
        F.concat(F.initcap("chain"), F.lit(" e-pood")).alias("name"), "chain",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.lit(True).alias("is_online"), F.lit(None).cast("string").alias("address"),
    )
    return merged.unionByName(missing)
