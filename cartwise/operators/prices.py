"""Store prices: latest, with fallback, cheapest, rollups and mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.common import fresh, pick_first
from cartwise.operators.stores import effective_source
from cartwise.functions.geo import haversine_km


def effective_price(price: str = "price", promo: str = "promo_price") -> Column:
    """The promo price if there is one (zero means none), else the price."""
    return F.coalesce(F.nullif(F.col(promo), F.lit(0)), F.col(price))


def seen_time(df: DataFrame) -> Column:
    return F.coalesce("collected_at", "seen_at") if "collected_at" in df.columns else F.col("seen_at")


def latest_prices(prices: DataFrame, tie: str | None = None) -> DataFrame:
    """Newest row per (product, store); rows without a time come last.

    `tie` names a column that settles equal times. The per-key limit is applied
    before the shuffle, so a product that holds a third of the rows sends one
    row per store and input partition.
    """
    dated = prices.withColumn("collected_at", seen_time(prices))
    order = [F.col("collected_at").desc_nulls_last()]
    if tie:
        order.append(F.col(tie).asc())
    return pick_first(dated, ["product_id", "store_id"], *order)


def union_prices(own: DataFrame, source: DataFrame) -> DataFrame:
    """Own rows (priority 1) and rows taken from the source store (2)."""
    return own.withColumn("priority", F.lit(1)).unionByName(source.withColumn("priority", F.lit(2)))


def latest_prices_fallback(latest: DataFrame, stores: DataFrame, source_map: DataFrame) -> DataFrame:
    """Latest price per product and store, where a store's own row wins and its
    mapped source fills the gaps.

    Own and borrowed rows meet in one aggregation keyed on (product, store):
    `min` on the priority picks the own row, with partial aggregation before
    the shuffle. `latest` needs unique (product, store).
    """
    own = latest.select("product_id", "store_id", "price", "collected_at")
    mapped = effective_source(stores, source_map).filter(F.col("store_id") != F.col("source_store_id"))
    known = stores.select(F.col("id").alias("store_id"))
    borrowed = own.withColumnRenamed("store_id", "source_store_id").join(mapped, "source_store_id").select(
        "product_id", "store_id", "price", "collected_at"
    )
    both = union_prices(own.join(known, "store_id", "left_semi"), borrowed)
    best = both.groupBy("product_id", "store_id").agg(
        F.min_by(F.struct("price", "collected_at", "priority"), "priority").alias("_row")
    )
    return best.select("product_id", "store_id", "_row.price", "_row.collected_at", "_row.priority")


def source_offers(latest: DataFrame) -> DataFrame:
    """Promo-aware prices where they were seen, before any store that borrows
    them is looked at."""
    return latest.select("product_id", "store_id", effective_price().alias("price"))


def latest_offers(prices: DataFrame, tie: str) -> DataFrame:
    """`source_offers` of the latest prices; only the price that counts is
    moved."""
    dated = prices.select("product_id", "store_id", seen_time(prices).alias("_at"), tie, effective_price().alias("price"))
    return pick_first(dated, ["product_id", "store_id"], F.col("_at").desc_nulls_last(), F.col(tie).asc()).drop("_at", tie)


def latest_prices_source_only(latest: DataFrame, stores: DataFrame, source_map: DataFrame) -> DataFrame:
    """Basket variant: a mapped store reads nothing but its source's rows, at
    the promo-aware price."""
    source = effective_source(stores, source_map)
    priced = latest.select(
        "product_id", F.col("store_id").alias("source_store_id"), effective_price().alias("price"), "collected_at"
    )
    return priced.join(source, "source_store_id").select("product_id", "store_id", "price", "collected_at")


def cheapest_offer(latest: DataFrame) -> DataFrame:
    """Cheapest row per product: price, then newest, then lowest store."""
    return pick_first(
        latest, "product_id", F.col("price").asc_nulls_last(), F.col("collected_at").desc_nulls_last(), F.col("store_id").asc()
    )


def cheapest_offer_agg(latest: DataFrame) -> DataFrame:
    """Same winner as `cheapest_offer` by one ordered aggregate."""
    age = -F.coalesce(F.unix_micros(F.col("collected_at").cast("timestamp")), F.lit(-(2**62)))
    order = F.struct(F.col("price").isNull(), F.col("price"), age, F.col("store_id"))
    return latest.groupBy("product_id").agg(
        F.min("price").alias("min_price"), F.min_by("store_id", order).alias("store_id"),
        F.min_by("collected_at", order).alias("collected_at"),
    )


def cheapest_within(latest: DataFrame, stores: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Cheapest row per product among the stores within a radius of a point."""
    distance = haversine_km(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"))
    near = stores.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (distance <= radius_km))
    return cheapest_offer(latest.join(near.select(F.col("id").alias("store_id")), "store_id", "left_semi"))


def dedupe_prices(prices: DataFrame, tie: str) -> DataFrame:
    """Keep the newest row per (product, store); rows without a key go."""
    keyed = prices.filter(F.col("product_id").isNotNull() & F.col("store_id").isNotNull())
    return latest_prices(keyed, tie)


def dedup_key(group: str = "group_id", product: str = "product_id") -> Column:
    """The group id, or `u_<product>` for a product outside all groups."""
    return F.coalesce(F.col(group).cast("string"), F.concat(F.lit("u_"), F.col(product).cast("string")))


def group_chains(prices: DataFrame, stores: DataFrame, members: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Per dedup key: the chains that price it and its lowest live price.

    Prices fold to one row per (product, chain) before they meet the group
    table; the set of chains is bounded by the number of chains.
    """
    live = prices.filter(F.col("price") > 0)
    if days is not None:
        live = fresh(live, as_of, days)
    shops = stores.select(F.col("id").alias("store_id"), F.lower("chain").alias("chain"))
    per_chain = live.join(shops, "store_id").groupBy("product_id", "chain").agg(F.min(effective_price()).alias("price"))
    keyed = per_chain.join(members.select("product_id", "group_id"), "product_id", "left")
    return keyed.groupBy(dedup_key().alias("dedup_key")).agg(
        F.array_sort(F.collect_set("chain")).alias("chains"), F.min("price").alias("min_price")
    )


def group_chain_price(prices: DataFrame, stores: DataFrame, members: DataFrame, promo_aware: bool = False) -> DataFrame:
    """Lowest price of each group in each chain; the list price by default."""
    price = effective_price() if promo_aware else F.col("price")
    shops = stores.select(F.col("id").alias("store_id"), F.lower("chain").alias("chain"))
    per_product = prices.join(shops, "store_id").groupBy("product_id", "chain").agg(F.min(price).alias("price"))
    return per_product.join(members.select("product_id", "group_id"), "product_id").groupBy("group_id", "chain").agg(
        F.min("price").alias("price")
    )


def min_edge_price(edges: DataFrame, product: str = "product_ref") -> DataFrame:
    """Lowest positive price over the store rows of a product reference."""
    return edges.filter(F.col("price") > 0).groupBy(product).agg(F.min("price").alias("price"))


def mirror_rows(online_prices: DataFrame, stores: DataFrame) -> DataFrame:
    """An online store's rows copied to every physical store of its chain."""
    online = F.coalesce(F.col("is_online"), F.lit(False))
    sources = stores.filter(online).select(F.col("id").alias("_online"), "chain")
    targets = stores.filter(~online).select(F.col("id").alias("store_id"), "chain")
    pairs = sources.join(targets, "chain")
    return online_prices.join(pairs, online_prices["store_id"] == pairs["_online"]).select(
        "product_id", pairs["store_id"], "price", "collected_at",
        F.concat(F.lit("mirror:"), F.col("chain"), F.lit(":online")).alias("source"),
    )


def online_copies(online_prices: DataFrame, stores: DataFrame, *order: Column) -> DataFrame:
    """The first online row under `order` for each product and chain: what all
    physical stores of the chain take over."""
    online = F.coalesce(F.col("is_online"), F.lit(False))
    sources = stores.filter(online & F.col("chain").isNotNull()).select(F.col("id").alias("store_id"), "chain")
    rows = online_prices.select("product_id", "store_id", "price", "collected_at").join(sources, "store_id").drop("store_id")
    return pick_first(rows.withColumn("source", F.concat(F.lit("mirror:"), F.col("chain"), F.lit(":online"))), ["product_id", "chain"], *order)


def mirror_targets(stores: DataFrame) -> DataFrame:
    """chain, store_id of the physical stores."""
    return stores.filter(~F.coalesce(F.col("is_online"), F.lit(False))).select("chain", F.col("id").alias("store_id")).distinct()


def spread_copies(current: DataFrame, copies: DataFrame, targets: DataFrame, key: list[str], order: list[Column], keeps) -> DataFrame:
    """`current` after the copies, unique by product and `key`, have gone to all
    `targets` (`key`, store_id) of their key; `keeps(old, new)` says whether the
    old row of a store stays.

    Copies are spread last, past the stores that hold a row of the product
    already, so no spread row is sorted, joined or moved. Only stores under
    several keys have theirs put in `order` one by one.
    """
    fields = ["price", "collected_at", "source"]
    shops = targets.select(*key, "store_id").distinct().withColumn("_keys", F.count("*").over(Window.partitionBy("store_id")))
    one, many = shops.filter("_keys = 1").drop("_keys"), shops.filter("_keys > 1").drop("_keys")
    crossed = pick_first(copies.join(many, key), ["product_id", "store_id"], *order)
    new = copies.select("product_id", *key, F.struct(*fields).alias("_new"))
    met = current.join(one.filter("store_id IS NOT NULL"), "store_id", "left").join(new, ["product_id", *key], "left").join(
        crossed.select("product_id", "store_id", F.struct(*fields).alias("_crossed")), ["product_id", "store_id"], "left"
    )
    met = met.select("product_id", "store_id", *key, F.struct(*fields).alias("_old"), "_new", F.coalesce("_new", "_crossed").alias("_best"))
    old = F.col("_best").isNull() | keeps("_old", "_best")
    there = met.select("product_id", "store_id", F.when(old, F.col("_old")).otherwise(F.col("_best")).alias("_row"))
    taken = met.filter(F.col("_new").isNotNull()).groupBy("product_id", *key).agg(F.collect_set("store_id").alias("_taken"))
    spread = new.join(taken, ["product_id", *key], "left").join(one, key).filter(~F.coalesce(F.array_contains("_taken", F.col("store_id")), F.lit(False)))
    rest = crossed.join(current.select("product_id", "store_id"), ["product_id", "store_id"], "left_anti")
    rows = there.unionByName(spread.select("product_id", "store_id", F.col("_new").alias("_row"))).unionByName(
        rest.select("product_id", "store_id", F.struct(*fields).alias("_row"))
    )
    return rows.select("product_id", "store_id", *[F.col(f"_row.{f}").alias(f) for f in fields])


def mirror_prices(current: DataFrame, incoming: DataFrame, stores: DataFrame) -> DataFrame:
    """Current rows after the online rows in `incoming` were mirrored; a row
    whose source is 'physical' stays as it is, and so does an earlier copy that
    is newer than the incoming one, or as new and not dearer.

    `current` has unique (product, store); if a batch mirrors a key twice the
    newest wins, then the lower price.
    """
    order = [F.col("collected_at").desc_nulls_last(), F.col("price").asc(), F.col("source").asc()]
    seen = lambda side: F.coalesce(F.unix_micros(F.col(f"{side}.collected_at").cast("timestamp")), F.lit(-(2**62)))

    def keeps(old: str, new: str) -> Column:
        late = F.coalesce(F.col(f"{old}.source").startswith("mirror:"), F.lit(False)) & (
            (seen(old) > seen(new)) | (seen(old) == seen(new)) & F.coalesce(F.col(f"{old}.price") <= F.col(f"{new}.price"), F.lit(False))
        )
        return F.col(f"{old}.source").eqNullSafe("physical") | late

    return spread_copies(current, online_copies(incoming, stores, *order), mirror_targets(stores), ["chain"], order, keeps)


def price_matrix(
    prices: DataFrame, stores: DataFrame, members: DataFrame, groups: DataFrame, chains: list[str],
    as_of, days: int,
) -> DataFrame:
    """Group by chain price table with the lowest and highest price, the spread
    and the chains that hold them. The pivot names its chains, so no extra
    pass looks for them."""
    live = fresh(prices.filter(F.col("price") > 0), as_of, days)
    shops = stores.select(F.col("id").alias("store_id"), F.lower("chain").alias("chain"))
    per_product = live.join(shops, "store_id").groupBy("product_id", "chain").agg(F.min(effective_price()).alias("price"))
    wide = (
        per_product.join(members.select("product_id", "group_id"), "product_id")
        .groupBy("group_id").pivot("chain", chains).agg(F.min("price"))
    )
    cells = [F.col(f"`{c}`") for c in chains]
    low, high = F.least(*cells), F.greatest(*cells)
    named = lambda edge: F.concat_ws(",", *[F.when((c == edge) & (low != high), F.lit(n)) for n, c in zip(chains, cells)])
    return (
        wide.filter(low.isNotNull())
        .withColumns({"min_price": low, "max_price": high})
        .withColumns({
            "best_chains": named(F.col("min_price")), "highest_chains": named(F.col("max_price")),
            "spread": F.col("max_price") - F.col("min_price"),
            "spread_pct": F.bround((F.col("max_price") - F.col("min_price")) / F.nullif(F.col("min_price"), F.lit(0)) * 100, 1),
        })
        .join(groups.select(F.col("id").alias("group_id"), F.col("canonical_name").alias("name")), "group_id")
    )


def spread_summary(matrix: DataFrame, chains: list[str]) -> DataFrame:
    """How many groups are tracked and the mean and largest spread over groups
    priced by two chains or more."""
    priced = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in chains), F.lit(0))
    spread = F.when(priced >= 2, F.col("spread"))
    return matrix.agg(F.count("*").alias("tracked"), F.avg(spread).alias("avg_spread"), F.max(spread).alias("max_spread"))


