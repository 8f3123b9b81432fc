"""Partner analytics over the event log: totals, series, rankings, momentum,
assortment gaps and price sensitivity. Both periods of a comparison come from
one pass with conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.common import blank_to_null, fresh, in_period, moment, top_n

# Event kinds and thresholds of the dashboard.
EVENT_TYPES = ("product_view", "basket_add", "basket_win")
MIN_DEVICES = 10
MIN_CURRENT, MIN_PREVIOUS = 3, 2
MIN_VIEWS = 5
MIN_COMPARES, MIN_CHAIN_COMPARES = 30, 10
OTHER_CATEGORY = "Muu"


def is_kind(kind: str) -> Column:
    return F.col("event_type") == kind


def of_chain(events: DataFrame, chain: str | None) -> DataFrame:
    """Events of one chain, any case; all events without one."""
    return events if chain is None else events.filter(F.lower("chain") == chain.lower())


def event_totals(events: DataFrame, as_of, days: int, keys: list[str] | None = None) -> DataFrame:
    """Adds, views, wins, devices and users of the period (`cur_`) and of the
    one before it (`prev_`), over all events or per key. Distinct counts are
    exact; Spark splits them into a partial distinct per key first."""
    spans = {"cur": in_period(events, as_of, days), "prev": in_period(events, as_of, days, back=1)}
    aggs = []
    for name, inside in spans.items():
        aggs += [
            F.count_if(inside & is_kind("basket_add")).alias(f"{name}_adds"),
            F.count_if(inside & is_kind("product_view")).alias(f"{name}_views"),
            F.count_if(inside & is_kind("basket_win")).alias(f"{name}_wins"),
            F.count_distinct(F.when(inside, blank_to_null("device_key"))).alias(f"{name}_devices"),
            F.count_distinct(F.when(inside, F.col("user_id"))).alias(f"{name}_users"),
        ]
    scoped = events.filter(spans["cur"] | spans["prev"])
    return scoped.groupBy(*(keys or [])).agg(*aggs)


#: Logarithm of the buckets of a device sketch: about 0.4 % error.
SKETCH_BITS = 16


def daily_sketches(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per day and key: adds, views, wins, and mergeable sketches of devices
    and users. Days are small rows that any period can be put together from,
    so a report reads no events."""
    device = blank_to_null("device_key")
    return events.groupBy(F.to_date("created_at").alias("day"), *(keys or [])).agg(
        *(F.count_if(is_kind(kind)).alias(name) for kind, name in (("basket_add", "adds"), ("product_view", "views"), ("basket_win", "wins"))),
        F.hll_sketch_agg(device, F.lit(SKETCH_BITS)).alias("devices"), F.hll_sketch_agg(F.col("user_id").cast("string"), F.lit(SKETCH_BITS)).alias("users"),
    )


def sketched_totals(daily: DataFrame, as_of, days: int, keys: list[str] | None = None) -> DataFrame:
    """`event_totals` from daily sketches: counts are exact, distinct devices
    and users are estimates. The exact totals stay the default."""
    spans = {"cur": in_period(daily, as_of, days, column="day"), "prev": in_period(daily, as_of, days, back=1, column="day")}
    aggs = []
    for name, inside in spans.items():
        aggs += [F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for c in ("adds", "views", "wins")]
        aggs += [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(inside, F.col(c)))), F.lit(0)).alias(f"{name}_{c}") for c in ("devices", "users")]
    return daily.filter(spans["cur"] | spans["prev"]).groupBy(*(keys or [])).agg(*aggs)


def period_delta(current: Column, previous: Column) -> Column:
    """Change in percent with one decimal; `new` when there was nothing before,
    NULL when there is nothing at all."""
    change = F.bround((current - previous) / previous * 100, 1)
    return F.when((previous == 0) & (current > 0), "new").when(previous != 0, F.format_string("%.1f", change))


def rate(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, NULL of an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1))


def suppress_small(value: Column, devices: Column, is_admin: bool = False, threshold: int = MIN_DEVICES) -> Column:
    """A figure hidden from partners when too few devices stand behind it."""
    return value if is_admin else F.when(devices >= threshold, value)


def day(column: str = "created_at") -> Column:
    return F.to_date(F.col(column))


def daily_series(events: DataFrame, as_of, days: int, kinds: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """One row per day of the period, quiet days included, with a count per
    event kind."""
    inside = events.filter(in_period(events, as_of, days))
    counts = inside.groupBy(day().alias("day")).agg(*[F.count_if(is_kind(k)).alias(k) for k in kinds])
    today = F.to_date(F.lit(str(as_of)))
    every = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    return every.join(counts, "day", "left").select("day", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def active_days(series: DataFrame) -> DataFrame:
    """Days with an add or a win."""
    return series.agg(F.count_if((F.col("basket_add") > 0) | (F.col("basket_win") > 0)).alias("active_days"))


def event_summary(events: DataFrame, as_of, days: int, chain: str | None = None) -> DataFrame:
    """Events by kind of one chain, or by chain and kind."""
    start = moment(events, "created_at", as_of) - F.make_dt_interval(F.lit(days))
    recent = of_chain(events, chain).filter(F.col("created_at") >= start)
    keys = ["event_type"] if chain else ["chain", "event_type"]
    return recent.groupBy(*keys).agg(F.count("*").alias("count"))


def top_products(events: DataFrame, products: DataFrame, as_of, days: int, chain: str | None = None, limit: int = 10) -> DataFrame:
    """Products added most. Counting comes before the name is looked up, so
    the join sees one row per product and chain."""
    added = of_chain(events, chain).filter(is_kind("basket_add") & F.col("product_id").isNotNull() & in_period(events, as_of, days))
    counts = added.groupBy("product_id", "chain").agg(F.count("*").alias("adds"))
    top = counts.orderBy(F.col("adds").desc(), F.col("product_id"), F.col("chain").asc_nulls_last()).limit(limit)
    return top.join(products.select(F.col("id").alias("product_id"), "name"), "product_id", "left")


def category_counts(events: DataFrame, product_labels: DataFrame, as_of, days: int) -> DataFrame:
    """Adds per category label now and before; products without a label count
    as other."""
    cur, prev = in_period(events, as_of, days), in_period(events, as_of, days, back=1)
    per_product = events.filter(is_kind("basket_add") & F.col("product_id").isNotNull() & (cur | prev)).groupBy("product_id").agg(
        F.count_if(cur).alias("_cur"), F.count_if(prev).alias("_prev")
    )
    label = F.coalesce("label", F.lit(OTHER_CATEGORY)).alias("category")
    return per_product.join(product_labels, "product_id").groupBy(label).agg(
        F.sum("_cur").alias("current_cnt"), F.sum("_prev").alias("prev_cnt")
    )


def category_demand(counts: DataFrame, limit: int = 8) -> DataFrame:
    return counts.filter("current_cnt > 0").select("category", F.col("current_cnt").alias("cnt")).orderBy(
        F.col("cnt").desc(), F.col("category")
    ).limit(limit)


def category_momentum(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Both periods side by side; a category of one period only counts zero in
    the other. Inputs have category and cnt."""
    return current.withColumnRenamed("cnt", "_c").join(previous.withColumnRenamed("cnt", "_p"), "category", "full_outer").select(
        "category", F.coalesce("_c", F.lit(0)).alias("current_cnt"), F.coalesce("_p", F.lit(0)).alias("prev_cnt")
    )


def momentum(counts: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """Growing keys: at least three now, and either nothing before (new) or at
    least two before and growth above zero; largest first, new ahead of
    grown ones of the same size."""
    growth = F.bround((F.col("current_cnt") - F.col("prev_cnt")) / F.col("prev_cnt") * 100, 1)
    rising = counts.filter(F.col("current_cnt") >= MIN_CURRENT).withColumn("is_new", F.col("prev_cnt") == 0)
    rising = rising.withColumn("growth", F.when(F.col("prev_cnt") >= MIN_PREVIOUS, growth))
    kept = rising.filter(F.col("is_new") | (F.col("growth") > 0))
    order = F.when(F.col("is_new"), F.lit(999.0)).otherwise(F.col("growth"))
    return kept.orderBy(F.col("current_cnt").desc(), order.desc(), F.col(key)).limit(limit)


def product_momentum(events: DataFrame, as_of, days: int) -> DataFrame:
    cur, prev = in_period(events, as_of, days), in_period(events, as_of, days, back=1)
    return events.filter(is_kind("basket_add") & F.col("product_id").isNotNull() & (cur | prev)).groupBy("product_id").agg(
        F.count_if(cur).alias("current_cnt"), F.count_if(prev).alias("prev_cnt")
    )


def low_conversion(events: DataFrame, as_of, days: int, limit: int = 8) -> DataFrame:
    """Products looked at often and added rarely."""
    counts = events.filter(F.col("product_id").isNotNull() & in_period(events, as_of, days)).groupBy("product_id").agg(
        F.count_if(is_kind("product_view")).alias("views"), F.count_if(is_kind("basket_add")).alias("adds")
    )
    return counts.filter(F.col("views") >= MIN_VIEWS).orderBy((F.col("adds") / F.col("views")).asc(), F.col("product_id")).limit(limit)


def brand_scope(partners: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Products and groups of each brand partner: the group brand equals one of
    the partner's brands, case aside, without wildcards."""
    wanted = partners.select("partner_id", F.explode("brand_filter").alias("_brand")).select("partner_id", F.lower("_brand").alias("_brand")).distinct()
    owned = groups.select(F.col("id").alias("group_id"), F.lower("brand").alias("_brand")).join(wanted, "_brand").drop("_brand")
    return owned.join(members.select("group_id", "product_id"), "group_id")


def group_demand(events: DataFrame, members: DataFrame, as_of, days: int) -> DataFrame:
    """Views and adds per group; events fold to products before the join."""
    seen = events.filter(F.col("event_type").isin("product_view", "basket_add") & F.col("product_id").isNotNull() & in_period(events, as_of, days))
    per_product = seen.groupBy("product_id").agg(
        F.count_if(is_kind("product_view")).alias("_v"), F.count_if(is_kind("basket_add")).alias("_a")
    )
    return per_product.join(members.select("product_id", "group_id"), "product_id").groupBy("group_id").agg(
        F.sum("_v").alias("views"), F.sum("_a").alias("adds"), F.sum(F.col("_v") + F.col("_a")).alias("demand")
    )


def carried_groups(prices: DataFrame, stores: DataFrame, members: DataFrame, as_of, days: int) -> DataFrame:
    """Distinct (group, chain) with a fresh positive price."""
    shops = stores.select(F.col("id").alias("store_id"), F.lower("chain").alias("chain"))
    live = fresh(prices.filter(F.col("price") > 0), as_of, days).join(shops, "store_id").select("product_id", "chain").distinct()
    return live.join(members.select("product_id", "group_id"), "product_id").select("group_id", "chain").distinct()


def chain_coverage(carried: DataFrame, groups: DataFrame, chains: list[str]) -> DataFrame:
    """Groups each chain carries out of all groups; every chain is listed."""
    every = groups.agg(F.count("*").alias("total_groups")).withColumn("chain", F.explode(F.array(*[F.lit(c) for c in chains])))
    own = carried.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi").groupBy("chain").agg(F.count("*").alias("covered"))
    return every.join(own, "chain", "left").select("chain", F.coalesce("covered", F.lit(0)).alias("covered"), "total_groups")


def missing_assortment(events: DataFrame, products: DataFrame, members: DataFrame, prices: DataFrame, stores: DataFrame, chain: str, as_of_events, days: int, as_of_prices, price_days: int) -> DataFrame:
    """Demanded groups (or lone products) that one chain does not carry fresh,
    named after their most demanded product."""
    seen = events.filter(F.col("event_type").isin("basket_add", "product_view") & F.col("product_id").isNotNull() & in_period(events, as_of_events, days))
    counts = seen.groupBy("product_id").agg(F.count("*").alias("_n"))
    named = counts.join(products.select(F.col("id").alias("product_id"), "name"), "product_id")
    grouped = named.join(members.select("product_id", "group_id"), "product_id", "left").withColumn("grp", F.coalesce("group_id", -F.col("product_id")))
    demand = grouped.groupBy("grp").agg(
        F.sum("_n").alias("demand_count"), F.min_by("name", F.struct(-F.col("_n"), F.col("product_id"))).alias("name")
    )
    shops = stores.filter(F.lower("chain") == chain.lower()).select(F.col("id").alias("store_id"))
    live = fresh(prices.filter(F.col("price") > 0), as_of_prices, price_days).join(shops, "store_id", "left_semi").select("product_id").distinct()
    # only demanded products can rule a demanded group out
    has = grouped.join(live, "product_id", "left_semi").select("grp").distinct()
    return demand.join(has, "grp", "left_anti")


def opportunities(demand: DataFrame, carried: DataFrame, chains: list[str], per_chain: int = 5) -> DataFrame:
    """Demanded groups each chain lacks, the most demanded first."""
    wanted = demand.select("group_id", "demand", F.explode(F.array(*[F.lit(c) for c in chains])).alias("chain"))
    return top_n(wanted.join(carried, ["group_id", "chain"], "left_anti"), "chain", per_chain, F.col("demand").desc(), F.col("group_id"))


def chain_ranking(events: DataFrame, as_of, days: int, chains: list[str], viewer: str | None = None) -> DataFrame:
    """Chains by wins with ties, chains without wins included. A partner sees
    its own name and letters for the others, given in rank order."""
    wins = events.filter(is_kind("basket_win") & in_period(events, as_of, days)).groupBy(F.lower("chain").alias("chain")).agg(F.count("*").alias("_wins"))
    every = events.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in chains])).alias("chain"))
    table = every.join(wins, "chain", "left").select("chain", F.coalesce("_wins", F.lit(0)).alias("wins"))
    whole = Window.orderBy(F.col("wins").desc())  # as many rows as there are chains
    ranked = table.withColumn("position", F.rank().over(whole)).withColumn("tied", F.count("*").over(Window.partitionBy("wins")) > 1)
    if viewer is None:
        return ranked.withColumn("shown_as", F.initcap("chain"))
    other = F.col("chain") != viewer.lower()
    letter = F.sum(other.cast("int")).over(Window.orderBy(F.col("wins").desc(), F.col("chain")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(
        "shown_as", F.when(other, F.concat(F.lit("Konkurent "), F.char(letter + 64))).otherwise(F.initcap("chain"))
    )


def last_event(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return events.groupBy(*(keys or [])).agg(F.max("created_at").alias("last_event"))


def fill_rate(df: DataFrame, column: str) -> DataFrame:
    """Rows and rows where a column is filled."""
    return df.agg(F.count("*").alias("total"), F.count(column).alias("filled"))


def chain_of_lowest(lowest: DataFrame, stores: DataFrame) -> DataFrame:
    """product_id, chain of rows that have the store of a product's lowest price."""
    shops = stores.select(F.col("id").alias("store_id"), F.lower("chain").alias("chain"))
    return lowest.select("product_id", "store_id").join(shops, "store_id").select("product_id", "chain")


def fill_chain(events: DataFrame, lowest: DataFrame) -> DataFrame:
    """Adds without a chain get the one of `lowest` (product_id, chain); chains
    become lower case."""
    fill = is_kind("basket_add") & blank_to_null("chain").isNull()
    return events.join(lowest.withColumnRenamed("chain", "_chain"), "product_id", "left").withColumn(
        "chain", F.when(fill, F.col("_chain")).otherwise(F.lower(blank_to_null("chain")))
    ).drop("_chain")


def attribute_chain(events: DataFrame, prices: DataFrame, stores: DataFrame) -> DataFrame:
    """Adds without a chain get the chain of the product's lowest price; chains
    become lower case."""
    best = prices.filter(F.col("price").isNotNull()).groupBy("product_id").agg(F.min(F.struct("price", "store_id")).alias("_b"))
    return fill_chain(events, chain_of_lowest(best.select("product_id", F.col("_b.store_id").alias("store_id")), stores))


COMPARE_PAYLOAD = T.StructType([
    T.StructField("cheapest_chain", T.StringType()),
    T.StructField("cheapest_total", T.DoubleType()),
    T.StructField("chain_totals", T.MapType(T.StringType(), T.DoubleType())),
])


def eligible_compares(compares: DataFrame) -> DataFrame:
    """Compare payloads that name a winner and at least two chain totals; chain
    names in lower case."""
    parsed = compares.select(F.from_json("payload", COMPARE_PAYLOAD).alias("p")).select("p.*")
    filled = F.map_filter("chain_totals", lambda k, v: v.isNotNull())
    entries = F.transform(F.map_entries(filled), lambda e: F.struct(F.trim(F.lower(e["key"])).alias("chain"), e["value"].alias("total")))
    return parsed.filter("cheapest_chain IS NOT NULL AND cheapest_total IS NOT NULL").select(
        F.trim(F.lower("cheapest_chain")).alias("winner"), F.col("cheapest_total").alias("winner_total"), entries.alias("totals")
    ).filter(F.size("totals") >= 2)


def price_sensitivity(compares: DataFrame, chains: list[str], unit: float = 1.0) -> DataFrame:
    """How narrowly each chain won or lost: gaps up to a half, one and two
    units, wins, and narrow losses by the winner. Chains with too few compares
    are left out, all of them when the whole period has too few. One pass
    serves every chain."""
    good = eligible_compares(compares)
    # one entry without a chain per compare counts the compares in the same pass
    whole = F.struct(F.lit(None).cast("string").alias("chain"), F.lit(None).cast("double").alias("total"))
    own = good.select("winner", "winner_total", "totals", F.explode(F.concat("totals", F.array(whole))).alias("_own")).select(
        "winner", "winner_total", F.col("_own.chain").alias("chain"), F.col("_own.total").alias("total"),
        F.array_min(F.transform(F.filter("totals", lambda e: e["chain"] != F.col("_own.chain")), lambda e: e["total"])).alias("rival"),
    ).filter(F.col("chain").isNull() | F.col("chain").isin(*chains))
    won = F.col("chain") == F.col("winner")
    gap = F.when(won, F.col("rival") - F.col("total")).otherwise(F.col("total") - F.col("winner_total")) / unit
    bucket = F.when((gap > 0) & (gap <= 0.5), "050").when((gap > 0.5) & (gap <= 1), "100").when((gap > 1) & (gap <= 2), "200")
    rows = own.withColumns({"won": won, "bucket": bucket})
    sides = {"loss": ~F.col("won"), "win": F.col("won")}
    counts = rows.groupBy("chain").agg(
        F.count("*").alias("compares"), F.count_if("won").alias("wins"),
        *[F.count_if(side & (F.col("bucket") == b)).alias(f"near_{name}_{b}") for name, side in sides.items() for b in ("050", "100", "200")],
    )
    every = F.max(F.when(F.col("chain").isNull(), F.col("compares"))).over(Window.partitionBy())  # a row per chain and one more
    return counts.withColumn("_all", every).filter(
        F.col("chain").isNotNull() & (F.col("compares") >= MIN_CHAIN_COMPARES) & (F.col("_all") >= MIN_COMPARES)
    ).drop("_all")


def narrow_losses(compares: DataFrame, chains: list[str], unit: float = 1.0, top: int = 3) -> DataFrame:
    """To whom each chain lost by one unit or less, the most frequent first."""
    good = eligible_compares(compares)
    own = good.select("winner", "winner_total", F.explode("totals").alias("_own")).select(
        "winner", F.col("_own.chain").alias("chain"), ((F.col("_own.total") - F.col("winner_total")) / unit).alias("gap")
    )
    lost = own.filter((F.col("chain") != F.col("winner")) & (F.col("gap") > 0) & (F.col("gap") <= 1) & F.col("chain").isin(*chains))
    counts = lost.groupBy("chain", "winner").agg(F.count("*").alias("losses"))
    return top_n(counts, "chain", top, F.col("losses").desc(), F.col("winner"))


def latency_report(log: DataFrame, keys: list[str], value: str = "latency_ms", shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles: the value at position round(p * (n - 1)) of
    the sorted log. Equal values are counted together first, and the running
    count goes over whole units, then inside the one unit that holds the rank,
    so no task sorts all rows of a key."""
    counted = log.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_unit", F.floor("_v"))
    units = counted.groupBy(*keys, "_unit").agg(F.sum("_n").alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0) if keys else Window.orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranks = units.withColumns({"_upto": F.sum("_n").over(run), "_all": F.sum("_n").over(whole)})
    wanted = F.array(*[F.struct(F.lit(f"p{p * 100:g}").alias("label"), F.bround(F.lit(p) * (F.col("_all") - 1), 0).cast("long").alias("rank")) for p in shares])
    hit = ranks.select(*keys, "_unit", "_upto", "_n", F.explode(wanted).alias("_w"))
    hit = hit.filter((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("_n")))
    hit = hit.select(*keys, "_unit", "_w.label", (F.col("_w.rank") - (F.col("_upto") - F.col("_n"))).alias("_rest"))
    inner = Window.partitionBy(*keys, "_unit").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    fine = counted.withColumn("_till", F.sum("_n").over(inner)).withColumn("_from", F.col("_till") - F.col("_n"))
    met = hit.join(fine, [*keys, "_unit"]).filter((F.col("_rest") < F.col("_till")) & (F.col("_rest") >= F.col("_from")))
    return met.groupBy(*keys).pivot("label", [f"p{p * 100:g}" for p in shares]).agg(F.first("_v"))


def export_events(events: DataFrame, products: DataFrame, as_of, days: int, chain: str | None = None) -> DataFrame:
    """Day, kind, chain and product counts of the period."""
    inside = of_chain(events, chain).filter(in_period(events, as_of, days))
    counts = inside.groupBy(day().alias("day"), "event_type", "chain", "product_id").agg(F.count("*").alias("_n"))
    named = counts.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id", "left")
    return named.groupBy("day", "event_type", "chain", "product_name").agg(F.sum("_n").alias("count"))


def export_brand(groups: DataFrame, demand: DataFrame, matrix: DataFrame, chains: list[str], cents: bool = False) -> DataFrame:
    """One row per group: views, adds, add rate, price per chain and the chains
    without one. Numbers use a decimal comma."""
    comma = lambda text: F.translate(text, ".", ",")
    scale = 100.0 if cents else 1.0
    rows = groups.select(F.col("id").alias("group_id"), F.coalesce("canonical_name", F.concat(F.lit("Toode #"), F.col("id"))).alias("name"))
    rows = rows.join(demand, "group_id", "left").join(matrix.select("group_id", *[F.col(f"`{c}`") for c in chains]), "group_id", "left")
    views, adds = F.coalesce("views", F.lit(0)), F.coalesce("adds", F.lit(0))
    share = comma(F.concat(F.format_string("%.1f", F.bround(adds / views * 100, 1)), F.lit("%")))
    money = lambda c: F.when(F.col(f"`{c}`").isNotNull(), comma(F.format_string("%.2f", F.col(f"`{c}`") / scale))).otherwise("")
    cells = [money(c).alias(f"price_{c.replace(' ', '_')}") for c in chains]
    lacking = F.array_join(F.array_except(
        F.array(*[F.lit(c.capitalize()) for c in chains]), F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), c.capitalize()) for c in chains]))
    ), ", ")
    return rows.select(
        "group_id", "name", views.alias("views"), adds.alias("adds"), F.when(views > 0, share).otherwise("").alias("add_rate"), *cells, lacking.alias("missing_chains")
    )
