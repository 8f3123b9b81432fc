"""Keyed merges of batches into tables.

Spark has no in-place update without a table format, so a merge takes the old
table and a batch and returns the whole new table; the caller writes it to a
new path or version. Every rule is order independent or states the order it
needs as a column.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.common import Keys, blank_to_null, dealt, names, pick_first, positions, settled
from cartwise.functions.codes import is_bad_ean, is_bogus_ean, normalize_ean


def dedupe_batch(batch: DataFrame, key: Keys, arrival: str = "arrival", keep: str = "first") -> DataFrame:
    """One row per key of a batch: the first or the last to arrive."""
    order = F.col(arrival).asc() if keep == "first" else F.col(arrival).desc()
    return pick_first(batch, key, order)


def item_key(ext_id: str = "ext_id", name: str = "name", barcode: str = "barcode") -> Column:
    """Key of a scraped item: its id, else name and barcode."""
    return F.coalesce(blank_to_null(ext_id), F.concat(F.coalesce(name, F.lit("")), F.lit("|"), F.coalesce(barcode, F.lit(""))))


def skip_known(batch: DataFrame, staged: DataFrame, keys: Keys = ("store_host", "ean_norm")) -> DataFrame:
    """Batch rows whose barcode is not staged for their host yet; rows without
    a barcode stay."""
    return batch.join(staged.select(*names(keys)).distinct(), names(keys), "left_anti")


def merge_overwrite(old: DataFrame, new: DataFrame, key: Keys) -> DataFrame:
    """Rows of the batch replace rows with the same key. Keys are unique on
    both sides (`dedupe_batch` first)."""
    return old.join(new.select(*names(key)), names(key), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_coalesce(old: DataFrame, new: DataFrame, key: Keys, blank: tuple[str, ...] = ()) -> DataFrame:
    """Batch values win where they are not NULL (for `blank` columns: not
    empty either); other values stay."""
    keys = names(key)
    values = [c for c in old.columns if c not in keys]
    fresh_ = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    pick = lambda c: F.nullif(F.col(f"_new_{c}"), F.lit("")) if c in blank else F.col(f"_new_{c}")
    return old.join(fresh_, keys, "full_outer").select(*keys, *[F.coalesce(pick(c), F.col(c)).alias(c) for c in values])


def write_prices(current: DataFrame, history: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current prices and history after a batch. Every row goes to history;
    the current row of a (product, store) is the newest, and of equal times
    the cheapest. An older row never replaces a newer one, so the order of
    batches does not matter."""
    fields = ["product_id", "store_id", "price", "seen_at"]
    rows = current.select(*fields).unionByName(batch.select(*fields))
    newest = pick_first(rows, ["product_id", "store_id"], F.col("seen_at").desc_nulls_last(), F.col("price").asc_nulls_last())
    return newest, history.unionByName(batch.select(*history.columns), allowMissingColumns=True)


def new_ids(rows: DataFrame, first_free: DataFrame, order: str, column: str = "id") -> DataFrame:
    """Give rows the ids after the highest used one, in the order of a unique
    numeric column, without a global sort in one task. `first_free` is the
    one-row table with the highest used id as `top`."""
    numbered = positions(rows, order, "_place")
    return numbered.join(F.broadcast(first_free)).withColumn(  # one row
        column, F.coalesce("top", F.lit(0)) + F.col("_place") + 1
    ).drop("_place", "top")


def upsert_products(products: DataFrame, batch: DataFrame, variant: str = "digits") -> tuple[DataFrame, DataFrame]:
    """Find or create the product of every batch row by barcode and return the
    product table and the price rows with their product.

    `batch` has arrival (unique), ean_raw, name, size_text, brand, store_id,
    price, collected_at. Rows with the same unknown barcode create one product,
    from the first of them; a row without a barcode always creates its own.
    """
    tidy = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    rows = batch.select(
        "arrival", normalize_ean(F.col("ean_raw"), variant).alias("ean"), tidy("name"), tidy("size_text"), tidy("brand"), "store_id", "price", "collected_at"
    )
    known = products.filter(blank_to_null("ean").isNotNull()).groupBy("ean").agg(F.min("id").alias("_known"))
    looked = rows.join(known, "ean", "left")
    unknown = looked.filter("_known IS NULL")
    makers = pick_first(unknown.filter("ean IS NOT NULL"), "ean", F.col("arrival").asc()).unionByName(unknown.filter("ean IS NULL"))
    top = products.agg(F.max("id").alias("top"))
    created = new_ids(makers.select("arrival", "ean", "name", "size_text", "brand"), top, "arrival")
    by_ean = created.filter("ean IS NOT NULL").select("ean", F.col("id").alias("_by_ean"))
    by_row = created.filter("ean IS NULL").select("arrival", F.col("id").alias("_by_row"))
    snapshots = looked.join(by_ean, "ean", "left").join(by_row, "arrival", "left").select(
        F.coalesce("_known", "_by_ean", "_by_row").alias("product_id"), "store_id", "price", "collected_at"
    )
    return products.unionByName(created.drop("arrival"), allowMissingColumns=True), snapshots


def upsert_catalog(
    products: DataFrame, prices: DataFrame, ext_map: DataFrame, batch: DataFrame, source: str, store_id: int, at
) -> tuple[DataFrame, DataFrame]:
    """Products and prices after a catalogue batch of one store.

    Rows without a positive price are skipped. The mapped product's price is
    written, its promo price is overwritten (no promo clears it), and barcode
    and image are filled only where they are missing. `batch` has one row per
    ext_id with price, promo_price, ean, image_url.
    """
    linked = ext_map.filter(F.col("source") == source).groupBy("ext_id").agg(F.min("product_id").alias("product_id"))
    rows = batch.filter(F.col("price") > 0).join(linked, "ext_id")
    fills = rows.groupBy("product_id").agg(
        F.min(blank_to_null("ean")).alias("_ean"), F.min(blank_to_null("image_url")).alias("_image")
    ).withColumnRenamed("product_id", "id")
    filled = products.join(fills, "id", "left").withColumns({
        "ean": F.coalesce(blank_to_null("ean"), "_ean", "ean"), "image_url": F.coalesce(blank_to_null("image_url"), "_image", "image_url"),
    }).drop("_ean", "_image")
    newest = pick_first(rows, "product_id", F.col("price").asc(), F.col("ext_id").asc()).select(
        "product_id", F.lit(store_id).cast(prices.schema["store_id"].dataType).alias("store_id"), "price", "promo_price",
        F.lit(str(at)).cast(prices.schema["collected_at"].dataType).alias("collected_at"), F.lit(source).alias("source"),
    )
    return filled, merge_overwrite(prices.select(newest.columns), newest, ["product_id", "store_id"])


def adopt_candidates(
    queue: DataFrame, products: DataFrame, eans: DataFrame, ext_map: DataFrame, prices: DataFrame, stores: DataFrame, chain: str, source: str, at
) -> dict[str, DataFrame]:
    """All queued candidates with a barcode at once: find or create the
    product, map the external id, write the price at the chain's first online
    store and take the row off the queue.

    Without an online store nothing is adopted. Candidates that share a new
    barcode create one product, named after the lowest ext_id; the price of a
    product several candidates lead to comes from the highest ext_id, the last
    one a loop in that order would write. `queue` carries a unique numeric
    `arrival`.
    """
    online = stores.filter((F.lower("chain") == chain.lower()) & F.coalesce(F.col("is_online"), F.lit(False)))
    shop = online.agg(F.min("id").alias("_store")).filter("_store IS NOT NULL")
    ready = queue.filter(blank_to_null("ean_norm").isNotNull()).join(F.broadcast(shop))  # one row
    known = eans.groupBy("ean_norm").agg(F.min("product_id").alias("_known"))
    looked = ready.join(known, "ean_norm", "left")
    makers = pick_first(looked.filter("_known IS NULL"), "ean_norm", F.col("ext_id").asc())
    created = new_ids(makers.select("arrival", "ean_norm", "ean_raw", blank_to_null("name").alias("name")), products.agg(F.max("id").alias("top")), "arrival")
    resolved = looked.join(created.select("ean_norm", F.col("id").alias("_made")), "ean_norm", "left").withColumn(
        "product_id", F.coalesce("_known", "_made")
    )
    links = resolved.select("ext_id", "product_id", F.lit(source).alias("source"))
    last = pick_first(resolved, "product_id", F.col("ext_id").desc()).select(
        "product_id", F.col("_store").cast(prices.schema["store_id"].dataType).alias("store_id"), "price",
        F.lit(str(at)).cast(prices.schema["collected_at"].dataType).alias("collected_at"), F.lit(source + ":online").alias("source"),
    )
    return {
        "products": products.select("id", "name").unionByName(created.select("id", "name")),
        "product_eans": eans.select("product_id", "ean_norm").unionByName(created.select(F.col("id").alias("product_id"), "ean_norm")),
        "ext_product_map": merge_overwrite(ext_map.select("ext_id", "product_id", "source"), links, "ext_id"),
        "prices": merge_overwrite(prices.select(last.columns), last, ["product_id", "store_id"]),
        "queue": queue.join(links.select("ext_id"), "ext_id", "left_anti"),
    }


#: Open items up to which a family's items are decided in one ordered pass.
FOLDED = 200_000


def merge_shared_baskets(existing: DataFrame, incoming: DataFrame, folded: int = FOLDED) -> DataFrame:
    """Outcome of every incoming item of shared baskets: rejected, skipped,
    repaired (with the row it repairs) or added, as if the items came one by
    one in arrival order.

    `existing` has family_id, id, product_id, ingredient_name_en, product_name;
    `incoming` has family_id, arrival (unique), product_id,
    ingredient_name_en, product_name. What an item meets depends on the items
    before it only through its identity (product or ingredient) and its name:
    an item succeeds when both are still free, and uses both up. See `_settle`.
    """
    identity = F.when(F.col("product_id").isNotNull(), F.concat(F.lit("p"), F.col("product_id"))).when(
        blank_to_null("ingredient_name_en").isNotNull(), F.concat(F.lit("i"), F.col("ingredient_name_en"))
    )
    norm = F.lower(F.trim("product_name"))
    # rows that already carry an identity; an ingredient counts only on rows without a product
    old = existing.withColumns({"_ident": identity, "_name": norm})
    known = old.filter("_ident IS NOT NULL").select("family_id", "_ident").distinct().withColumn("_known", F.lit(True))
    broken = old.filter("product_id IS NULL AND ingredient_name_en IS NULL").groupBy("family_id", "_name").agg(F.max("id").alias("_row"))
    taken = old.select("family_id", "_name").distinct().withColumn("_taken", F.lit(True))
    items = incoming.withColumns({"_ident": identity, "_name": norm})
    rejected = items.filter("_ident IS NULL").withColumn("outcome", F.lit("rejected")).withColumn("repairs", F.lit(None).cast("bigint"))
    real = items.filter("_ident IS NOT NULL").join(known, ["family_id", "_ident"], "left")
    first = F.row_number().over(Window.partitionBy("family_id", "_ident", "_name").orderBy("arrival"))
    real = real.withColumn("_nth", first).join(broken, ["family_id", "_name"], "left").join(taken, ["family_id", "_name"], "left")
    return _settle(real, folded).unionByName(rejected.select("family_id", "arrival", "product_name", "outcome", "repairs"))


def _in_order(rows: pa.Table) -> pa.Table:
    """Items of one family that succeed, one by one in arrival order."""
    ordered = rows.sort_by("arrival")
    idents, names_, kept = set(), set(), []
    for ident, name in zip(ordered["_ident"].to_pylist(), ordered["_name"].to_pylist()):
        free = ident not in idents and name not in names_
        kept.append(free)
        if free:
            idents.add(ident), names_.add(name)
    return ordered.filter(pa.array(kept, pa.bool_()))


def _settle(real: DataFrame, folded: int = FOLDED) -> DataFrame:
    """Decide items that have an identity.

    The successes are the greedy matching of identities to names in arrival
    order, family by family. A family of at most `folded` open items is decided
    in one ordered pass. Larger ones are decided in rounds: an item that came
    first among all open items of its identity and of its name succeeds, then
    everything that shares either with a success is out.
    """
    fields = ["family_id", "arrival", "product_name"]
    free = F.col("_known").isNull() & (F.col("_nth") == 1) & (F.col("_row").isNotNull() | F.col("_taken").isNull())
    remaining = settled(real.filter(free).select(*fields, "_ident", "_name", F.col("_row").cast("bigint").alias("repairs")))
    large = settled(remaining.groupBy("family_id").count().filter(F.col("count") > folded).select("family_id"))
    small = remaining.join(large, remaining["family_id"].eqNullSafe(large["family_id"]), "left_anti")
    won = [small.groupBy("family_id").applyInArrow(_in_order, remaining.schema)]
    remaining = remaining.join(large, "family_id", "left_semi")
    while not large.isEmpty() and not remaining.isEmpty():
        by_ident = remaining.groupBy("family_id", "_ident").agg(F.min("arrival").alias("_a"))
        by_name = remaining.groupBy("family_id", "_name").agg(F.min("arrival").alias("_b"))
        joined = remaining.join(by_ident, ["family_id", "_ident"]).join(by_name, ["family_id", "_name"])
        wins = settled(joined.filter((F.col("arrival") == F.col("_a")) & (F.col("arrival") == F.col("_b"))).drop("_a", "_b"))
        won.append(wins.select(*remaining.columns))
        remaining = settled(
            remaining.join(wins.select("family_id", "_ident"), ["family_id", "_ident"], "left_anti")
            .join(wins.select("family_id", "_name"), ["family_id", "_name"], "left_anti").select(*remaining.columns)
        )
    every = real.select(*fields)
    good = reduce(DataFrame.unionByName, won).select("family_id", "arrival", F.lit(True).alias("_won"), "repairs")
    outcome = F.when(F.col("_won").isNull(), "skipped").when(F.col("repairs").isNotNull(), "repaired").otherwise("added")
    return every.join(good, ["family_id", "arrival"], "left").select(*fields, outcome.alias("outcome"), "repairs")


def merge_counts(outcomes: DataFrame) -> DataFrame:
    """Items added, skipped, repaired and rejected per family."""
    kinds = ("added", "skipped", "repaired", "rejected")
    return outcomes.groupBy("family_id").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def bump_selections(selections: DataFrame, events: DataFrame, rows: int = 0) -> DataFrame:
    """Selection counters after a batch of picks, of about `rows` rows together
    where that is known."""
    picks = events.select("user_id", "product_id", F.lit(1).cast("long").alias("count"), F.col("at").alias("last_used"))
    both = selections.select("user_id", "product_id", "count", "last_used").unionByName(picks)
    if rows:
        both = dealt(both, rows, "user_id", "product_id")
    return both.groupBy("user_id", "product_id").agg(F.sum("count").alias("count"), F.max("last_used").alias("last_used"))


def add_favourites(favourites: DataFrame, events: DataFrame) -> DataFrame:
    """Favourites after a batch of additions; a favourite keeps its first time."""
    both = favourites.select("user_id", "product_id", "created_at").unionByName(events.select("user_id", "product_id", F.col("at").alias("created_at")))
    return both.groupBy("user_id", "product_id").agg(F.min("created_at").alias("created_at"))


def apply_quantities(products: DataFrame, parsed: DataFrame, commit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fill missing quantities and return the table and the log of changes with
    the values before. Without `commit` the table stays as it was."""
    found = parsed.select("id", F.struct("net_qty", "net_unit", "pack_count").alias("_new"))
    joined = products.join(found, "id", "left").withColumn("_apply", F.col("net_qty").isNull() & F.col("_new").isNotNull())
    log = joined.filter("_apply").select(
        "id", "name", F.struct("net_qty", "net_unit", "pack_count").alias("before"), F.col("_new").alias("after")
    )
    if not commit:
        return products, log
    value = lambda c: F.when(F.col("_apply"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    kept = [c for c in products.columns if c not in ("net_qty", "net_unit", "pack_count")]
    return joined.select(*kept, value("net_qty"), value("net_unit"), value("pack_count")), log


def apply_eans(products: DataFrame, found: DataFrame, overwrite_bad: bool) -> tuple[DataFrame, DataFrame]:
    """Outcome of every found barcode (product_id, ean, sku) and the products
    after it.

    BOGUS_CANDIDATE, EXISTS, SKIP_PRESENT, SKIP_NOT_BAD, DUP_FOUND, OVERWRITE
    or OK. A barcode that several products claim in one batch goes to the
    lowest product id; the others are duplicates, as in a loop over ids.
    """
    owners = products.filter(blank_to_null("ean").isNotNull()).groupBy("ean").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    rows = found.join(products.select(F.col("id").alias("product_id"), F.col("ean").alias("_prev")), "product_id").join(owners, "ean", "left")
    filled = blank_to_null("_prev").isNotNull()
    other = F.col("_low").isNotNull() & ((F.col("_low") != F.col("product_id")) | (F.col("_high") != F.col("product_id")))
    outcome = (
        F.when(is_bogus_ean(F.col("ean")), "BOGUS_CANDIDATE")
        .when(filled & (F.col("_prev") == F.col("ean")), "EXISTS")
        .when(filled & F.lit(not overwrite_bad), "SKIP_PRESENT")
        .when(filled & ~is_bad_ean(F.col("_prev")), "SKIP_NOT_BAD")
        .when(other, "DUP_FOUND")
        .when(filled, "OVERWRITE")
        .otherwise("OK")
    )
    rows = rows.withColumn("outcome", outcome)
    wins = F.col("outcome").isin("OK", "OVERWRITE")
    claims = rows.filter(wins).groupBy("ean").agg(F.min("product_id").alias("_winner"))
    rows = rows.join(claims, "ean", "left").withColumn("outcome", F.when(wins & (F.col("_winner") != F.col("product_id")), "DUP_FOUND").otherwise(F.col("outcome")))
    holder = F.coalesce("_winner", "_low")
    error = (
        F.when(F.col("outcome") == "BOGUS_CANDIDATE", F.concat(F.lit("bogus EAN "), F.col("ean")))
        .when(F.col("outcome") == "SKIP_PRESENT", F.concat(F.lit("has existing EAN "), F.col("_prev"), F.lit(", overwrite disabled")))
        .when(F.col("outcome") == "SKIP_NOT_BAD", F.concat(F.lit("existing EAN "), F.col("_prev"), F.lit(" not considered bad")))
        .when(F.col("outcome") == "DUP_FOUND", F.concat(F.lit("duplicate EAN "), F.col("ean"), F.lit(" already on product "), holder))
    )
    outcomes = rows.select("product_id", "ean", "outcome", error.alias("last_error"))
    written = outcomes.filter(F.col("outcome").isin("OK", "OVERWRITE")).select(F.col("product_id").alias("id"), F.col("ean").alias("_ean"))
    return outcomes, products.join(written, "id", "left").withColumn("ean", F.coalesce("_ean", "ean")).drop("_ean")


def queue_after(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Retry queue with one more attempt and the last error of each outcome."""
    seen = outcomes.select("product_id", F.lit(True).alias("_seen"), F.substring("last_error", 1, 500).alias("_error"))
    return queue.join(seen, "product_id", "left").select(
        "product_id", (F.col("attempts") + F.col("_seen").isNotNull().cast("int")).alias("attempts"),
        F.when(F.col("_seen").isNotNull(), F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def clear_images(products: DataFrame, urls: DataFrame) -> DataFrame:
    """Remove image addresses that are on a delete list."""
    marks = urls.select(F.col("url").alias("image_url")).distinct().withColumn("_gone", F.lit(True))
    return products.join(marks, "image_url", "left").withColumn("image_url", F.when(F.col("_gone").isNull(), F.col("image_url"))).drop("_gone")


def flag_missing_images(prices: DataFrame, note: str = "Kontrolli visuaali!") -> DataFrame:
    """Blank images become NULL and an empty note asks for a check; running it
    again changes nothing."""
    bare = blank_to_null("image_url").isNull()
    return prices.withColumns({
        "note": F.when(bare & blank_to_null("note").isNull(), note).otherwise(F.col("note")), "image_url": F.when(~bare, F.col("image_url")),
    })


def apply_images(prices: DataFrame, images: DataFrame, note: str = "Kontrolli visuaali!") -> DataFrame:
    """Set images by product, or by product, manufacturer and amount where the
    image names them; letter case is ignored, and the check note is cleared.
    A specific image wins over one for the product alone; the last of a key
    (by `arrival`) counts."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    keyed = images.select(low("product").alias("_p"), low("manufacturer").alias("_m"), low("amount").alias("_a"), "image_url", "arrival")
    latest = pick_first(keyed, ["_p", "_m", "_a"], F.col("arrival").desc())
    exact = latest.filter("_m <> '' OR _a <> ''").select("_p", "_m", "_a", F.col("image_url").alias("_exact"))
    plain = latest.filter("_m = '' AND _a = ''").select("_p", F.col("image_url").alias("_plain"))
    rows = prices.withColumns({
        "_p": F.lower("product"), "_m": F.lower(F.coalesce("manufacturer", F.lit(""))), "_a": F.lower(F.coalesce("amount", F.lit(""))),
    })
    joined = rows.join(exact, ["_p", "_m", "_a"], "left").join(plain, "_p", "left").withColumn("_image", F.coalesce("_exact", "_plain"))
    cleared = F.when(F.col("_image").isNotNull() & (F.col("note") == note), "").otherwise(F.col("note"))
    return joined.withColumns({"note": cleared, "image_url": F.coalesce("_image", "image_url")}).select(*prices.columns)


def erase_users(tables: dict[str, DataFrame], families: DataFrame, members: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """All tables without the erased users (user_id). A family passes to its
    earliest remaining member; one without members goes.

    `families` has id and owner_id, `members` has family_id, user_id and
    joined_at; every other table has user_id.
    """
    gone = users.select("user_id").distinct()
    kept = {name: df.join(gone, "user_id", "left_anti") for name, df in tables.items()}
    staying = members.join(gone, "user_id", "left_anti")
    heirs = staying.groupBy(F.col("family_id").alias("id")).agg(F.min(F.struct("joined_at", "user_id")).alias("_heir"))
    left = gone.select(F.col("user_id").alias("owner_id"), F.lit(True).alias("_left"))
    owned = families.join(heirs, "id").join(left, "owner_id", "left")
    kept["families"] = owned.withColumn("owner_id", F.when(F.col("_left").isNotNull(), F.col("_heir.user_id")).otherwise(F.col("owner_id"))).select(*families.columns)
    kept["family_members"] = staying.join(kept["families"].select(F.col("id").alias("family_id")), "family_id", "left_semi")
    return kept


def shared_basket_view(items: DataFrame, users: DataFrame) -> DataFrame:
    """Shared items with the adder's first name, or the part of the address
    before the at sign."""
    who = users.select(
        F.col("id").alias("user_id"), F.coalesce(blank_to_null("first_name"), F.substring_index("email", "@", 1)).alias("added_by")
    )
    return items.join(who, "user_id", "left")


def apply_labels(products: DataFrame, updates: DataFrame) -> DataFrame:
    """Category codes of the label table; the last label of a product (by
    `arrival`) counts and a missing code keeps the old one."""
    last = pick_first(updates, "product_id", F.col("arrival").desc()).select(
        F.col("product_id").alias("id"), blank_to_null("main_code").alias("_main"), blank_to_null("sub_code").alias("_sub")
    )
    return products.join(last, "id", "left").withColumns({
        "food_group": F.coalesce("_main", "food_group"), "sub_code": F.coalesce("_sub", "sub_code"),
    }).drop("_main", "_sub")


def label_matches(products: DataFrame, updates: DataFrame) -> DataFrame:
    """Labelled products and how many of them exist."""
    ids = updates.select(F.col("product_id").alias("id")).distinct()
    return ids.join(products.select("id", F.lit(1).alias("_hit")), "id", "left").agg(F.count("*").alias("labels"), F.count("_hit").alias("matched"))


def label_stats(products: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Totals and blanks, and the largest food groups."""
    blanks = lambda c: F.count_if(blank_to_null(c).isNull())
    totals = products.agg(F.count("*").alias("total"), blanks("food_group").alias("no_food_group"), blanks("sub_code").alias("no_sub_code"))
    groups = products.groupBy("food_group").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), F.col("food_group").asc_nulls_last()).limit(top)
    return totals, groups
