"""Substitutes for products a chain does not carry.

A request is a (group, chain) pair whose group has no price in the chain. The
rules look only at a few features of both sides: category, unit, quantity,
pack and the traits read from the texts. So both sides are first folded to
distinct feature combinations with counts and their lowest group ids, and the
rules run on pairs of combinations that can fit by quantity. Every figure of
the answer (counts, reasons, shortlist) is exact, but no category is ever
multiplied with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.common import blank_to_null, literal_map, pick_first, settled, top_n
from cartwise.functions import sizes, traits, vocab

SHORTLIST = 8
RULES_VERSION = "1"
KEY = ["sub_code", "chain", "want_unit"]
BIN = 0.1  # width of a bin of quantities, as a difference of logarithms; all limits are below 100 percent
CROWD = 2_000  # carried shapes of a bin from which it is dealt into parts
QTY = "decimal(12,3)"
REASONS = ("missing_rule", "missing_candidate_quantity", "unit_mismatch", "unknown_unit", "outside_allowed_range")


def gaps(groups: DataFrame, chains: list[str], priced: DataFrame) -> DataFrame:
    """Every (group, chain) without a price: groups times the fixed chains,
    less the priced pairs."""
    wanted = groups.select(F.col("id").alias("group_id"), F.explode(F.array(*[F.lit(c) for c in chains])).alias("chain"))
    return wanted.join(priced.select("group_id", "chain").distinct(), ["group_id", "chain"], "left_anti")


def has_quantity() -> Column:
    return (F.col("net_qty") > 0) & blank_to_null("net_unit").isNotNull()


def group_sample(members: DataFrame, products: DataFrame) -> DataFrame:
    """Sample product of each group: the lowest id that has a quantity, else
    the lowest id."""
    linked = members.select("group_id", F.col("product_id").alias("id")).join(products, "id")
    return pick_first(linked, "group_id", F.coalesce(has_quantity(), F.lit(False)).desc(), F.col("id").asc())


def profiles(groups: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """What the rules look at, for every member of every group: its unit as
    written, whether it has a quantity, and the number of its shape.

    A shape is a distinct combination of category, base unit, base quantity,
    multipack flag and traits. The texts are read once here; everything after
    works on shape numbers.
    """
    coded = groups.select(F.col("id").alias("group_id"), "sub_code", "canonical_name", "brand")
    linked = members.select("group_id", "product_id").join(coded, "group_id").join(products.withColumnRenamed("id", "product_id"), "product_id")
    text = traits.identity_text(F.col("canonical_name"), F.col("name"), F.col("brand"))
    linked = linked.withColumn("_text", text)
    unit = sizes.normalize_unit(F.col("net_unit"))
    qty = sizes.effective_qty(F.col("net_qty").cast(QTY), F.col("pack_count").cast(QTY))
    known = qty.isNotNull() & unit.isNotNull()
    shape = F.struct(
        "sub_code", F.when(known, unit["unit"]).alias("base_unit"),
        F.when(known, (qty * unit["factor"]).cast("decimal(28,6)")).alias("base_qty"),
        F.coalesce(F.col("pack_count") > 1, F.lit(False)).alias("multipack"),
        traits.hard_values(F.col("sub_code"), F.col("_text")).alias("hard"),
        traits.required_traits(F.col("_text")).alias("required"),
        traits.identity_traits(F.col("_text")).alias("identity"),
        traits.downgrade_tags(F.col("sub_code"), F.col("_text")).alias("tags"),
    )
    return settled(linked.select(
        "group_id", "product_id", "sub_code",
        F.lower(F.trim("net_unit")).alias("want_unit"),
        F.coalesce(F.col("net_qty") > 0, F.lit(False)).alias("has_qty"),
        F.coalesce(has_quantity(), F.lit(False)).alias("complete"),
        (F.coalesce(F.col("net_qty"), F.lit(0)) != 0).alias("_any_qty"),
        (F.coalesce("net_unit", F.lit("")) != "").alias("_any_unit"),
        (F.col("net_qty").isNull() | blank_to_null("net_unit").isNull()).alias("no_quantity"),
        shape.alias("shape"),
    ).withColumn("known", F.col("_any_qty") & F.col("_any_unit")).drop("_any_qty", "_any_unit"))


def number_shapes(profiled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct shapes with a number, and the profiles with it. The numbering
    is written down before it is used, so it is the same for every reader."""
    numbered = settled(profiled.select("shape").distinct().withColumn("shape_id", F.monotonically_increasing_id()))
    return numbered, profiled.join(numbered, "shape").withColumn("base_unit", F.col("shape.base_unit")).drop("shape")


def carried_products(prices: DataFrame, stores: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (group, chain, product) with a positive price. Prices fold to
    product and chain before anything else is joined."""
    shops = stores.select(F.col("id").alias("store_id"), F.lower("chain").alias("chain"))
    carried = prices.filter(F.col("price") > 0).join(shops, "store_id").select("product_id", "chain").distinct()
    return carried.join(members.select("group_id", "product_id"), "product_id")


def candidates(requests: DataFrame, carried: DataFrame, profiled: DataFrame, pool_limit: int | None = None) -> DataFrame:
    """Candidate pool per (category, chain, wanted unit): one sample product
    per group carried by the chain, best in the wanted unit, then with a
    quantity, then the lowest id.

    `requests` has sub_code, chain and want_unit. Pools of requests with the
    same three are the same and are built once. `pool_limit` keeps the lowest
    group ids only; without it the pool is whole.
    """
    pools = requests.select("sub_code", "chain", "want_unit").distinct()
    order = [F.col("has_qty").desc(), F.col("product_id").asc()]
    goods = carried.join(profiled, ["group_id", "product_id"])
    fields = ["product_id", "shape_id", "base_unit", "no_quantity"]
    any_unit = pick_first(goods, ["group_id", "chain"], *order)
    by_unit = pick_first(goods.filter("want_unit IS NOT NULL"), ["group_id", "chain", "want_unit"], *order)
    listed = any_unit.select("group_id", "chain", "sub_code", F.struct(*fields).alias("_any")).join(pools, ["sub_code", "chain"])
    exact = by_unit.select("group_id", "chain", "want_unit", F.struct(*fields).alias("_exact"))
    pool = listed.join(exact, ["group_id", "chain", "want_unit"], "left").withColumn("_sample", F.coalesce("_exact", "_any"))
    pool = pool.select("sub_code", "chain", "want_unit", "group_id", *[F.col(f"_sample.{f}").alias(f) for f in fields])
    if pool_limit is not None:
        pool = top_n(pool, KEY, pool_limit, F.col("group_id").asc())
    return pool


def limit_of(sub_code: Column, position: int) -> Column:
    """Automatic (0) or suggested (1) percentage limit of a category."""
    return literal_map({code: limits[position] for code, limits in vocab.QUANTITY_LIMITS.items()})[sub_code]


def quantity_tier(sub_code: Column, o_unit: Column, o_qty: Column, o_multi: Column, c_unit: Column, c_qty: Column, c_multi: Column) -> Column:
    """Tier of a pair by quantity alone: auto, suggested, incompatible or
    unknown. Units are base units and quantities are in them; NULL is unknown.
    The difference is compared by cross-multiplication, so it is exact."""
    gap = F.abs(c_qty - o_qty) * 100
    auto = gap <= o_qty * limit_of(sub_code, 0)
    return (
        F.when(o_unit.isNull() | c_unit.isNull() | o_qty.isNull() | c_qty.isNull(), "unknown")
        .when(o_unit != c_unit, "incompatible")
        .when(limit_of(sub_code, 0).isNull(), "unknown")
        .when(auto & (o_multi != c_multi), "suggested")
        .when(auto, "auto")
        .when(gap <= o_qty * limit_of(sub_code, 1), "suggested")
        .otherwise("incompatible")
    )


def reject_reason(sub_code: Column, tier: Column, o_unit: Column, c_unit: Column, no_quantity: Column) -> Column:
    """Why a pair failed by quantity; NULL when it did not."""
    return (
        F.when(tier.isin("auto", "suggested"), F.lit(None).cast("string"))
        .when((tier == "incompatible") & (o_unit != c_unit), "unit_mismatch")
        .when(tier == "incompatible", "outside_allowed_range")
        .when(limit_of(sub_code, 0).isNull(), "missing_rule")
        .when(no_quantity, "missing_candidate_quantity")
        .otherwise("unknown_unit")
    )


def tier_policy(sub_code: Column, tier: Column, o_tags: Column, c_tags: Column) -> Column:
    """Lower an automatic match whose downgrade tags differ or whose category
    allows none."""
    lowered = (o_tags != c_tags) | sub_code.isin(*vocab.AUTO_DISABLED)
    return F.when((tier == "auto") & lowered, "suggested").otherwise(tier)


def originals(requests: DataFrame, profiled: DataFrame) -> DataFrame:
    """Requested (group, chain) pairs with the profile of their sample."""
    sample = pick_first(profiled, "group_id", F.col("complete").desc(), F.col("product_id").asc())
    return requests.select("group_id", "chain").distinct().join(sample, "group_id")


def _bin(qty: Column) -> Column:
    return F.floor(F.log(qty.cast("double")) / BIN).cast("int")


def shape_pairs(asked: DataFrame, carried: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs of an asked and a carried shape (shape, shape_id) that fit by
    quantity, with their tier, the gap and whether the traits allow the pair.

    Quantities sit in logarithmic bins; an asked shape looks into the bins that
    the limit of its category reaches, and into no others. A bin with more than
    `crowd` carried shapes is dealt into parts, and those who look into it look
    into each. The pairs do not depend on the chain.
    """
    fields = {"sub_code": F.col("shape.sub_code"), "base_unit": F.col("shape.base_unit")}
    sized = lambda shapes: shapes.filter("shape.base_unit IS NOT NULL AND shape.base_qty > 0").withColumns(fields)
    qty, reach = F.col("shape.base_qty").cast("double"), limit_of(F.col("sub_code"), 1).cast("double") / 100
    # a little wider than the limit, as the limit itself is checked exactly
    low = _bin(qty * (1 - reach) * 0.999999)
    left = sized(asked).filter(reach.isNotNull()).select(
        "sub_code", "base_unit", F.explode(F.sequence(low, _bin(qty * (1 + reach) * 1.000001))).alias("_bin"), F.col("shape").alias("o"), F.col("shape_id").alias("o_shape")
    )
    right = sized(carried).select("sub_code", "base_unit", _bin(qty).alias("_bin"), F.col("shape").alias("c"), F.col("shape_id").alias("c_shape"))
    key = ["sub_code", "base_unit", "_bin"]
    parts = right.groupBy(*key).agg(F.ceil(F.count("*") / crowd).cast("int").alias("_parts"))
    left = left.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = right.join(parts, key).withColumn("_part", F.pmod(F.xxhash64("c_shape"), F.col("_parts")).cast("int")).drop("_parts")
    pairs = left.join(right, [*key, "_part"])
    o, c, sub = F.col("o"), F.col("c"), F.col("sub_code")
    tier = quantity_tier(sub, o["base_unit"], o["base_qty"], o["multipack"], c["base_unit"], c["base_qty"], c["multipack"])
    pairs = pairs.withColumn("tier", tier).filter(F.col("tier").isin("auto", "suggested"))
    usable = traits.traits_ok(o["required"], c["required"], o["identity"], c["identity"]) & traits.hard_ok(sub, o["hard"], c["hard"])
    pairs = pairs.withColumn("final", tier_policy(sub, F.col("tier"), o["tags"], c["tags"]))
    return pairs.select(
        "o_shape", "c_shape", "tier", "final", F.abs(c["base_qty"] - o["base_qty"]).alias("gap"),
        F.round(F.abs(c["base_qty"] - o["base_qty"]) / o["base_qty"] * 100, 4).cast("double").alias("diff_percent"),
        (usable & (~sub.isin(*vocab.EXACT_ONLY) | (F.col("final") == "auto"))).alias("usable"),
    )


def _pool_counts(pool: DataFrame) -> DataFrame:
    """Per pool: size, rows by base unit and rows without a usable quantity."""
    unknown = F.col("base_unit").isNull()
    return pool.groupBy(*KEY).agg(
        F.count("*").alias("n_total"),
        *[F.count_if(F.col("base_unit") == u).alias(f"n_{u}") for u in ("g", "ml", "tk")],
        F.count_if(unknown & F.col("no_quantity")).alias("n_missing"),
        F.count_if(unknown & ~F.col("no_quantity")).alias("n_unclear"),
    )


def matches(wanted: DataFrame, pool: DataFrame, shapes: DataFrame, shortlist: int = SHORTLIST) -> tuple[DataFrame, DataFrame]:
    """Counts and shortlist per (chain, wanted unit, original shape).

    Of each candidate shape only the lowest ids up to the shortlist length can
    be listed, and of all shapes only that many can lead, so both are cut
    before ids are spread out.
    """
    at = ["chain", "want_unit"]
    asked = wanted.filter("base_unit IS NOT NULL").select(*at, F.col("shape_id").alias("o_shape")).distinct()
    goods = pool.filter("base_unit IS NOT NULL").select(*at, F.col("shape_id").alias("c_shape"), "group_id")
    sizes_ = goods.groupBy(*at, "c_shape").agg(F.count("*").alias("c_count"))
    lowest = top_n(goods, [*at, "c_shape"], shortlist, F.col("group_id").asc())
    lowest = lowest.groupBy(*at, "c_shape").agg(F.array_sort(F.collect_list("group_id")).alias("c_ids"))
    kinds = sizes_.join(lowest, [*at, "c_shape"])
    of = lambda ids, column: shapes.join(ids.select(F.col(column).alias("shape_id")).distinct(), "shape_id", "left_semi")
    met = asked.join(shape_pairs(of(asked, "o_shape"), of(goods, "c_shape")), "o_shape").join(kinds, [*at, "c_shape"])
    counted = lambda test: F.sum(F.when(test, F.col("c_count")).otherwise(0))
    key = [*at, "o_shape"]
    counts = met.groupBy(*key).agg(
        counted(F.col("tier") == "auto").alias("quantity_auto_count"),
        counted(F.col("tier") == "suggested").alias("quantity_suggested_count"),
        counted(F.col("usable")).alias("trait_eligible_count"),
    )
    ranked = met.filter("usable").select(*key, F.col("final").alias("tier"), "gap", "diff_percent", "c_ids")
    order = [(F.col("tier") != "auto").asc(), F.col("gap").asc()]
    leading = top_n(ranked, key, shortlist, *order, F.get("c_ids", F.lit(0)).asc())
    listed = leading.withColumn("candidate_id", F.explode("c_ids")).drop("c_ids")
    return counts, top_n(listed, key, shortlist, *order, F.col("candidate_id").asc(), rank="position")


def decide(
    requests: DataFrame, groups: DataFrame, members: DataFrame, products: DataFrame, prices: DataFrame, stores: DataFrame,
    verdicts: DataFrame | None = None, pool_limit: int | None = None, shortlist: int = SHORTLIST,
) -> tuple[DataFrame, DataFrame]:
    """Decision and trace of every request, and the shortlists.

    `verdicts` (group_id, chain, selected_group_id, semantic_match) replaces a
    semantic model; a choice outside the shortlist is refused. Without
    verdicts the first of the shortlist is taken.
    """
    carried = carried_products(prices, stores, members)
    open_requests = requests.select("group_id", "chain").join(carried, ["group_id", "chain"], "left_anti")
    shapes, profiled = number_shapes(profiles(groups, members, products))
    wanted = settled(originals(open_requests, profiled))
    asked = wanted.filter("known")
    pool = settled(candidates(asked, carried, profiled, pool_limit))
    counts, listed = matches(asked, pool, shapes, shortlist)
    counts, listed = (df.withColumnRenamed("o_shape", "shape_id") for df in (counts, listed))
    short = asked.select("group_id", "chain", "sub_code", "want_unit", "shape_id").join(listed, ["chain", "want_unit", "shape_id"]).select(
        "group_id", "chain", "candidate_id", "tier", "position", "diff_percent"
    )
    if verdicts is None:
        chosen = short.filter("position = 1").select("group_id", "chain", F.struct("candidate_id", "tier", "diff_percent").alias("_pick"))
    else:
        agreed = verdicts.filter("semantic_match AND selected_group_id IS NOT NULL").select(
            "group_id", "chain", F.col("selected_group_id").alias("candidate_id")
        )
        chosen = short.join(agreed, ["group_id", "chain", "candidate_id"]).select(
            "group_id", "chain", F.struct("candidate_id", "tier", "diff_percent").alias("_pick")
        )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    rows = (
        wanted.withColumnRenamed("known", "_known")
        .join(counts, ["chain", "want_unit", "shape_id"], "left")
        .join(_pool_counts(pool), KEY, "left")
        .join(chosen, ["group_id", "chain"], "left")
    )
    ruled = limit_of(F.col("sub_code"), 0).isNotNull()
    same = F.when(F.col("base_unit") == "g", F.col("n_g")).when(F.col("base_unit") == "ml", F.col("n_ml")).when(F.col("base_unit") == "tk", F.col("n_tk"))
    same = F.coalesce(same, F.lit(0))
    total = F.when(F.col("_known"), F.coalesce("n_total", F.lit(0))).otherwise(0)
    measured = F.coalesce(F.col("n_g") + F.col("n_ml") + F.col("n_tk"), F.lit(0))
    mismatch = F.when(F.col("base_unit").isNotNull(), measured - same).otherwise(0)
    fitting = F.coalesce("quantity_auto_count", F.lit(0)) + F.coalesce("quantity_suggested_count", F.lit(0))
    outside = F.when(ruled, same - fitting).otherwise(0)
    unknown = total - mismatch - outside - fitting
    missing = F.when(ruled, F.coalesce("n_missing", F.lit(0))).otherwise(0)
    eligible = F.coalesce("trait_eligible_count", F.lit(0))
    decision = (
        F.when(~F.col("_known"), "no_quantity_data")
        .when(eligible == 0, "no_eligible_candidates")
        .when(F.col("_pick").isNull(), "semantic_rejected")
        .when(F.col("_pick.tier") == "auto", "auto_substitute")
        .otherwise("suggested_substitute")
    )
    live = group_price(carried_prices(prices, stores, members))
    decided = rows.select(
        "group_id", "chain", "sub_code", decision.alias("decision_type"),
        F.col("_pick.candidate_id").alias("substitute_group_id"),
        (decision == "auto_substitute").alias("included_in_total"),
        F.col("_pick.diff_percent").alias("quantity_diff_percent"),
        ruled.alias("quantity_rule_found"),
        total.cast("long").alias("sql_candidate_count"),
        fitting.cast("long").alias("quantity_eligible_count"),
        zero("quantity_auto_count"), zero("quantity_suggested_count"),
        F.when(F.col("_known"), mismatch + outside).otherwise(0).cast("long").alias("quantity_incompatible_count"),
        F.when(F.col("_known"), unknown).otherwise(0).cast("long").alias("quantity_unknown_count"),
        zero("trait_eligible_count"),
        F.least(eligible, F.lit(shortlist)).cast("long").alias("shortlist_count"),
        F.when(F.col("_known") & ~ruled, unknown).otherwise(0).cast("long").alias("missing_rule"),
        F.when(F.col("_known"), missing).otherwise(0).cast("long").alias("missing_candidate_quantity"),
        F.when(F.col("_known"), mismatch).otherwise(0).cast("long").alias("unit_mismatch"),
        F.when(F.col("_known") & ruled, unknown - missing).otherwise(0).cast("long").alias("unknown_unit"),
        F.when(F.col("_known"), outside).otherwise(0).cast("long").alias("outside_allowed_range"),
    )
    priced_pick = live.withColumnRenamed("group_id", "substitute_group_id")
    return decided.join(priced_pick, ["substitute_group_id", "chain"], "left"), short


def carried_prices(prices: DataFrame, stores: DataFrame, members: DataFrame) -> DataFrame:
    """List prices folded to (product, chain), with the group."""
    shops = stores.select(F.col("id").alias("store_id"), F.lower("chain").alias("chain"))
    lowest = prices.join(shops, "store_id").groupBy("product_id", "chain").agg(F.min("price").alias("price"))
    return lowest.join(members.select("group_id", "product_id"), "product_id")


def group_price(carried: DataFrame) -> DataFrame:
    return carried.groupBy("group_id", "chain").agg(F.min("price").alias("price"))


def expires_at(decision: Column, at: Column) -> Column:
    """End of validity of a decision; a day for unlisted kinds."""
    days = F.coalesce(literal_map(vocab.DECISION_DAYS)[decision], F.lit(1))
    return at + F.make_dt_interval(days)


def reuse_decisions(requests: DataFrame, cache: DataFrame, as_of, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached decisions that still hold, with the price read anew, and the
    requests to compute. A row holds for its rules version until it expires."""
    at = F.lit(str(as_of)).cast(cache.schema["expires_at"].dataType)
    valid = cache.filter((F.col("substitution_rules_version") == vocab.RULES_VERSION) & (F.col("expires_at") > at))
    valid = valid.withColumnRenamed("original_group_id", "group_id")
    hit = requests.select("group_id", "chain").join(valid, ["group_id", "chain"])
    price = live.select(F.col("group_id").alias("substitute_group_id"), "chain", "price")
    return hit.join(price, ["substitute_group_id", "chain"], "left"), requests.join(valid, ["group_id", "chain"], "left_anti")


def merge_decisions(cache: DataFrame, decided: DataFrame, as_of) -> DataFrame:
    """Cache after saving decisions: one row per group, chain and version."""
    at = F.lit(str(as_of)).cast(cache.schema["expires_at"].dataType)
    fields = ["original_group_id", "chain", "substitution_rules_version", "substitute_group_id", "decision_type", "included_in_total",
              "quantity_diff_percent", "expires_at"]
    new = decided.select(
        F.col("group_id").alias("original_group_id"), "chain", F.lit(vocab.RULES_VERSION).alias("substitution_rules_version"),
        "substitute_group_id", "decision_type", "included_in_total", "quantity_diff_percent", expires_at(F.col("decision_type"), at).alias("expires_at"),
    )
    key = fields[:3]
    return cache.select(*fields).join(new, key, "left_anti").unionByName(new)


def share_of(column: str, parts: int = 10_000) -> Column:
    """A stable number below `parts` for a key, the same in every engine that
    has md5."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts))


def missing_lines(baskets: DataFrame, members: DataFrame, groups: DataFrame, open_pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Basket lines that a chain near the basket doesn't carry: request_id,
    position, group_id, sub_code, chain and the first store of the chain in
    reach. `open_pairs` are the (group, chain) without a price."""
    reach = near.groupBy("basket_id", F.lower("chain").alias("chain")).agg(F.min("store_id").alias("first_seen_store_id"))
    lines = baskets.select("basket_id", "product_id").join(members.select("product_id", "group_id"), "product_id")
    coded = groups.select(F.col("id").alias("group_id"), "sub_code")
    met = lines.join(coded, "group_id").join(reach, "basket_id").join(open_pairs.select("group_id", F.lower("chain").alias("chain")), ["group_id", "chain"])
    return met.select(F.col("basket_id").alias("request_id"), F.col("product_id").alias("position"), "group_id", "sub_code", "chain", "first_seen_store_id")


def shadow_sample(missing: DataFrame, categories: list[str], rate: float = 0.05, per_request: int = 2) -> DataFrame:
    """Shadow work of compare requests: a stable share of the requests, watched
    categories only, each (group, chain) once per request, a few per request.
    `missing` has request_id, position, group_id, sub_code, chain and
    first_seen_store_id. The share is taken by hash, so a rerun samples the same
    requests."""
    sampled = missing.filter(F.col("sub_code").isin(*categories) & (share_of("request_id") < int(rate * 10_000)))
    once = sampled.groupBy("request_id", "group_id", "sub_code", F.lower("chain").alias("chain")).agg(
        F.min("position").alias("position"), F.min("first_seen_store_id").alias("first_seen_store_id")
    )
    return top_n(once, "request_id", per_request, F.col("position").asc(), F.col("group_id").asc(), F.col("chain").asc())


def shadow_events(sampled: DataFrame, decided: DataFrame, rules_version: str = RULES_VERSION) -> DataFrame:
    """One event for each sampled line with what the rules decided for it, and
    the figures behind the decision as JSON."""
    trace = F.to_json(F.struct("sql_candidate_count", "quantity_auto_count", "quantity_suggested_count", "trait_eligible_count"))
    answers = decided.select(
        "group_id", F.lower("chain").alias("chain"), "substitute_group_id", "decision_type", F.col("price").alias("candidate_price"), trace.alias("trace")
    )
    return sampled.join(answers, ["group_id", "chain"]).select(
        F.col("request_id").alias("compare_request_id"), F.lit(rules_version).alias("rules_version"), "chain", "first_seen_store_id",
        F.col("group_id").alias("original_group_id"), "substitute_group_id", "sub_code", "decision_type", "candidate_price", "trace",
    )


def decision_report(decided: DataFrame) -> DataFrame:
    """Decisions per kind over distinct cases."""
    cases = decided.select("group_id", F.lower("chain").alias("chain"), "decision_type").distinct()
    return cases.groupBy("decision_type").agg(F.count("*").alias("cases"))
