"""Catalogue: display rows, browse, search, alternatives, matching of scraped
rows, product grouping and upkeep reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.common import blank_to_null, dealt, fresh, pick_first, settled, top_n
from cartwise.functions import vocab
from cartwise.functions.names import canonical_name, contains_any, produce_family, unaccent
from cartwise.functions.similarity import set_similarity, trigrams, word_similarity
from cartwise.functions.sizes import parse_quantity, size_in_name
from cartwise.operators.prices import dedup_key, effective_price
from cartwise.operators.textsearch import find_inside, shared_grams

MAX_PAGE = 50  # Fixed value: page size limit
NAME_MATCH = 0.55  # Fixed value: similarity of a good name match


def effective_sub_code(group: str = "group_sub_code", product: str = "sub_code") -> Column:
    """Curated group category, else the product's own."""
    return F.coalesce(blank_to_null(group), blank_to_null(product))


def with_fresh_price(products: DataFrame, prices: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Products with any fresh price. Fresh prices fold to product ids first."""
    live = fresh(prices, as_of, days).select(F.col("product_id").alias("id")).distinct()
    return products.join(live, "id", "left_semi")


def with_group(products: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Products with their group's curated fields and the dedup key."""
    curated = groups.select(
        F.col("id").alias("group_id"), "canonical_name", F.col("brand").alias("group_brand"), F.col("sub_code").alias("group_sub_code")
    )
    linked = members.select(F.col("product_id").alias("id"), "group_id").join(curated, "group_id", "left")
    return products.join(linked, "id", "left").withColumn("dedup_key", dedup_key("group_id", "id"))


def shown_name() -> Column:
    return F.coalesce(blank_to_null("canonical_name"), F.coalesce("name", F.lit("")))


def safe_product(rows: DataFrame) -> DataFrame:
    """Display row: curated name and brand, no size text that the name already
    shows, sorted distinct chains."""
    size = F.trim(F.coalesce("size_text", F.lit("")))
    per_kg = F.lower(size) == "kg"
    chains = F.array_sort(F.array_distinct(F.coalesce("chains", F.array().cast("array<string>"))))
    return rows.select(
        "id", "group_id", shown_name().alias("name"), F.trim(F.coalesce("group_brand", F.lit(""))).alias("brand"),
        F.when(~per_kg & size_in_name(shown_name()), "").otherwise(size).alias("size_text"),
        per_kg.alias("is_per_kg"), "sub_code", chains.alias("available_chains"), "min_price",
    )


def product_detail(products: DataFrame, members: DataFrame, groups: DataFrame, rollup: DataFrame) -> DataFrame:
    """Display row of every product with its chain rollup."""
    return safe_product(with_group(products, members, groups).join(rollup, "dedup_key", "left"))


def source_rank() -> Column:
    """Rank of the source a product was scraped from."""
    url = F.lower(F.col("source_url"))
    has = lambda word: url.contains(word)
    return (
        F.when(has("prisma"), 1).when(has("selver"), 2).when(has("rimi"), 3).when(has("barbora") | has("maxima"), 4)
        .when(has("ecoop") | (has("coop") & ~has("wolt")), 5).when(has("wolt"), 6).when(blank_to_null("source_url").isNull(), 7).otherwise(8)
    )


def browse_dedupe(grouped: DataFrame) -> DataFrame:
    """One product per dedup key: best source, then one with an image, then
    with a barcode, then the lowest id."""
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return pick_first(grouped, "dedup_key", source_rank(), lacks("image_url"), lacks("ean"), F.col("id"))


def browse(grouped: DataFrame, sub_code: str | None = None, main_code: str | None = None, brand: str | None = None) -> DataFrame:
    """Category and brand filter; the sub category wins over the main one and
    blank values do not filter."""
    value = lambda v: (v or "").strip() or None
    sub_code, main_code, brand = value(sub_code), value(main_code), value(brand)
    if sub_code:
        grouped = grouped.filter(F.coalesce(blank_to_null("group_sub_code"), F.col("sub_code")) == sub_code)
    elif main_code:
        grouped = grouped.filter(F.col("food_group") == main_code)
    return grouped.filter(F.trim("group_brand") == brand) if brand else grouped


def browse_order(sort: str | None = None, personal: bool = False) -> list[Column]:
    """Total order of a browse list."""
    tail = [shown_name().asc(), F.col("id").asc()]
    if sort == "price_asc":
        return [F.col("min_price").asc_nulls_last(), *tail]
    if sort == "price_desc":
        return [F.col("min_price").desc_nulls_last(), *tail]
    return [F.coalesce("selection_count", F.lit(0)).desc(), *tail] if personal else tail


def paginate(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with `has_more` and `next_offset`. The extra row that proves a
    next page is read and dropped. A page longer than MAX_PAGE is refused."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows, not {limit}")
    page = df.orderBy(*order).offset(offset).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # at most limit + 1 rows
    numbered = page.withColumn("_row", place).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    following = F.when(F.col("has_more"), F.lit(offset + limit))
    return numbered.filter(F.col("_row") <= limit).drop("_row").withColumn("next_offset", following)


def selection_totals(selections: DataFrame, members: DataFrame, rows: int = 0) -> DataFrame:
    """How often each user picked each dedup key; `rows` is about the number of
    selections, where it is known."""
    keyed = selections.join(members.select("product_id", "group_id"), "product_id", "left").select("user_id", dedup_key().alias("dedup_key"), "count")
    if rows:
        keyed = dealt(keyed, rows, "user_id", "dedup_key")
    return keyed.groupBy("user_id", "dedup_key").agg(F.sum("count").alias("selection_count"))


def search_text(*parts: Column) -> Column:
    return unaccent(F.lower(F.concat_ws(" ", *parts)))


def query_tokens(q: Column) -> Column:
    """Usable words of a search: two letters or more, without accents."""
    return F.transform(F.filter(F.split(F.trim(F.lower(q)), r"\s+"), lambda w: F.length(w) >= 2), lambda w: unaccent(w))


def token_search(grouped: DataFrame, q: str) -> DataFrame:
    """Products where every word of the search occurs in the product text or in
    the group text; no usable word finds nothing."""
    words = [w for w in q.lower().split() if len(w) >= 2]
    if not words:
        return grouped.limit(0)
    for word in words:
        plain = unaccent(F.lit(word))
        grouped = grouped.filter(F.coalesce("search_text", F.lit("")).contains(plain) | F.coalesce("group_search_text", F.lit("")).contains(plain))
    return grouped


def token_search_join(queries: DataFrame, grouped: DataFrame) -> DataFrame:
    """Many searches at once; `queries` has query_id and q.

    A word may stand anywhere inside a text, so an equality join on words would
    lose hits; distinct words are looked up in distinct texts by their rarest
    gram, and a text counts when all words do.
    """
    words_of = F.array_sort(F.array_distinct(query_tokens(F.col("q"))))
    asked = queries.select("query_id", words_of.alias("_words")).filter(F.size("_words") > 0)
    wanted = asked.select("_words").distinct()  # searches repeat; each set of words is answered once
    words = wanted.select("_words", F.explode("_words").alias("word"))
    both = F.concat_ws("\n", F.coalesce("search_text", F.lit("")), F.coalesce("group_search_text", F.lit("")))
    texts = grouped.select(both.alias("text")).distinct()
    held = find_inside(words, texts)
    full = words.join(held, "word").groupBy("_words", "text").agg(F.count("*").alias("_hits")).filter(F.col("_hits") == F.size("_words"))
    hits = full.select("_words", "text").join(grouped.withColumn("text", both), "text").drop("text")
    return asked.join(hits, "_words").drop("_words")


def relevance_tier(q: Column) -> Column:
    """0 exact name, 1 name prefix, 2 exact curated brand, 3 any other hit."""
    name = F.lower(shown_name())
    return F.when(name == q, 0).when(name.startswith(q), 1).when(F.lower(F.coalesce("group_brand", F.lit(""))) == q, 2).otherwise(3)


def relevance_rank(hits: DataFrame, q: str) -> DataFrame:
    norm = " ".join(q.lower().split())
    return hits.withColumn("tier", relevance_tier(F.lit(norm))).orderBy("tier", shown_name(), "id")


def category_of(names: DataFrame, grouped: DataFrame) -> DataFrame:
    """Category of each named product: equal product name, equal curated name,
    then a name that contains it, then the lowest id.

    Exact hits are one equi-join; only names without one are looked up inside
    the texts, behind the same index as a search.
    """
    coded = grouped.withColumn("code", effective_sub_code()).filter("code IS NOT NULL")
    wanted = names.select("product_name").distinct()
    spoken = coded.select(F.lower("name").alias("_key"), "code", "id", F.lit(0).alias("tier")).unionByName(
        coded.filter("canonical_name IS NOT NULL").select(F.lower("canonical_name").alias("_key"), "code", "id", F.lit(1).alias("tier"))
    )
    best = spoken.groupBy("_key").agg(F.min(F.struct("tier", "id", "code")).alias("_best"))
    keyed = wanted.withColumn("_key", F.lower(F.trim("product_name"))).join(best, "_key", "left")
    exact = keyed.filter("_best IS NOT NULL").select("product_name", F.col("_best.code").alias("sub_code"))
    rest = keyed.filter("_best IS NULL AND _key <> ''").select("product_name", "_key")
    texts = coded.select(F.lower("name").alias("text"), "id", "code").unionByName(
        coded.filter("canonical_name IS NOT NULL").select(F.lower("canonical_name").alias("text"), "id", "code")
    ).groupBy("text").agg(F.min(F.struct("id", "code")).alias("_best"))
    held = find_inside(rest.select(F.col("_key").alias("word")), texts, (1, 2, 3))
    inside = rest.join(held, F.col("_key") == F.col("word")).join(texts, "text")
    found = inside.groupBy("product_name").agg(F.min("_best").alias("_best")).select("product_name", F.col("_best.code").alias("sub_code"))
    return exact.unionByName(found)


def _families(name: Column, canonical: Column, code: Column) -> Column:
    """Produce families a product can stand in for; the empty family stands
    for no family filter."""
    low, curated = F.lower(name), F.lower(F.coalesce(canonical, F.lit("")))
    own = F.array_compact(F.array(*[
        F.when(contains_any(low, stems) | contains_any(curated, stems), family) for family, stems, _ in vocab.PRODUCE_FAMILIES
    ]))
    return F.when(code.isin(*vocab.FAMILY_FILTER_CATEGORIES), F.concat(F.array(F.lit("")), own)).otherwise(F.array(F.lit("")))


def similar_names(kinds: DataFrame, stocked: DataFrame, shelf: list[str], limit: int) -> DataFrame:
    """(shelf, wanted, shown, similarity) of names above zero that can be among
    the first `limit` dedup keys of their shelf for a wanted name.

    Names that share a trigram meet. What `limit` keys of the shelf reach at
    least, by the lower bounds of their names, a name must be able to reach by
    its upper bound; only such names are scored.
    """
    met = shared_grams(kinds, stocked, "code")
    key = [*shelf, "wanted"]
    placed = kinds.join(met, ["code", "wanted"]).join(stocked.select(*shelf, "shown", "dedup_key"), [*shelf, "shown"])
    placed = settled(placed.select(*key, "shown", "dedup_key", "upper", "lower"))
    sure = placed.groupBy(*key, "dedup_key").agg(F.max("lower").alias("lower"))
    sure = top_n(sure, key, limit, F.desc("lower"), F.col("dedup_key")).groupBy(*key).agg(F.min("lower").alias("_least"), F.count("*").alias("_n"))
    able = placed.join(sure, key).filter((F.col("_n") < limit) | (F.col("upper") >= F.col("_least"))).select(*key, "shown").distinct()
    scored = able.select("wanted", "shown").distinct().withColumn("similarity", word_similarity(F.col("wanted"), F.col("shown")))
    return able.join(scored, ["wanted", "shown"]).filter("similarity > 0")


def alternatives(
    requests: DataFrame, grouped: DataFrame, prices: DataFrame, source: DataFrame, as_of, days: int = 7, limit: int = 6, tie: str = "price_id",
) -> DataFrame:
    """Similar goods of the same category in one store for each request
    (request_id, product_name, store_id).

    Prices come from the store's effective source, newest first. Categories
    with produce families keep the family of the wanted name only. The order is
    similarity, price, name. Goods with a similarity come from `similar_names`;
    the cheapest goods of the shelf, one row for each dedup
    key, fill up what is left, and twice the limit of them is enough, as fewer
    than the limit can be similar when there is something to fill.

    Requests are made once. What depends on a name is done once a name, and all
    else once for each shelf and name; a request only meets the result.
    """
    requests = settled(requests.select("request_id", "product_name", "store_id"))
    seen = settled(requests.select("product_name", "store_id").distinct())
    grouped = settled(grouped.select("id", "name", "canonical_name", "group_sub_code", "sub_code", "dedup_key"))
    coded = category_of(seen, grouped).withColumnRenamed("sub_code", "code")
    family = F.when(F.col("code").isin(*vocab.FAMILY_FILTER_CATEGORIES), produce_family(F.col("product_name")))
    coded = coded.withColumn("family", F.coalesce(family, F.lit("")))
    stem = F.coalesce(*[F.when(F.col("family") == f, stems[0]) for f, stems, _ in vocab.PRODUCE_FAMILIES])
    coded = settled(coded.withColumn("wanted", unaccent(F.lower(F.coalesce(stem, F.trim("product_name"))))))
    shelf = ["source_store_id", "code", "family"]
    kinds = settled(seen.join(coded, "product_name").join(source, "store_id").select(*shelf, "wanted").distinct())
    asked = requests.join(coded, "product_name").join(source, "store_id")
    recent = fresh(prices.filter(F.col("price") > 0), as_of, days)
    shelves = kinds.select(F.col("source_store_id").alias("store_id")).distinct()
    latest = pick_first(recent.join(shelves, "store_id", "left_semi"), ["product_id", "store_id"], F.col("collected_at").desc_nulls_last(), F.col(tie).desc())
    offers = latest.select(F.col("product_id").alias("id"), F.col("store_id").alias("source_store_id"), effective_price().alias("price"))
    goods = grouped.withColumn("code", F.coalesce(blank_to_null("group_sub_code"), F.col("sub_code"))).select(
        "id", "name", "dedup_key", "code", unaccent(F.lower(shown_name())).alias("shown"),
        F.explode(_families(F.col("name"), F.col("canonical_name"), F.col("code"))).alias("family"),
    )
    stocked = offers.join(goods, "id").groupBy(*shelf, "dedup_key", "shown").agg(F.min(F.struct("price", "id", "name")).alias("_best"))
    stocked = settled(stocked.select(*shelf, "dedup_key", "shown", "_best.*"))
    alike = similar_names(kinds, stocked, shelf, limit).join(stocked, [*shelf, "shown"])
    whole = stocked.groupBy(*shelf, "dedup_key").agg(F.min(F.struct("price", "id", "name")).alias("_best")).select(*shelf, "dedup_key", "_best.*")
    cheap = top_n(whole, shelf, 2 * limit, F.col("price").asc(), F.col("name").asc(), F.col("id").asc())
    filler = kinds.join(cheap, shelf).withColumn("similarity", F.lit(0.0))
    fields = [*shelf, "wanted", "dedup_key", "similarity", "price", "id", "name"]
    both = alike.select(*fields).unionByName(filler.select(*fields))
    key = [*shelf, "wanted"]
    once = pick_first(both, [*key, "dedup_key"], F.col("similarity").desc(), F.col("price").asc(), F.col("id").asc())
    best = top_n(once, key, limit, F.col("similarity").desc(), F.col("price").asc(), F.col("name").asc(), F.col("id").asc(), rank="position")
    return asked.join(best, key).select("request_id", "store_id", "id", "dedup_key", F.col("code").alias("sub_code"), "similarity", "price", "position")


def brand_filter(groups: DataFrame, rollup: DataFrame) -> DataFrame:
    """Whether each category gets a brand filter, why not, and the numbers."""
    live = rollup.filter("min_price IS NOT NULL").select("dedup_key").distinct()
    seen = groups.withColumn("dedup_key", F.col("id").cast("string")).join(live, "dedup_key", "left_semi")
    per_brand = seen.groupBy("sub_code", blank_to_null("brand").alias("_brand")).agg(F.count_distinct("id").alias("_n"))
    named = F.col("_brand").isNotNull()
    counts = per_brand.groupBy("sub_code").agg(
        F.sum("_n").alias("total_groups"), F.sum(F.when(named, F.col("_n")).otherwise(0)).alias("branded_groups"),
        F.count_if(named).alias("total_brands"), F.count_if(named & (F.col("_n") >= vocab.MIN_GROUPS_PER_BRAND)).alias("eligible_brands"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(named & (F.col("_n") >= vocab.MIN_GROUPS_PER_BRAND), F.struct((-F.col("_n")).alias("n"), F.col("_brand").alias("b"))))), lambda s: s["b"]), ",").alias("brands"),
    )
    codes = groups.filter("sub_code IS NOT NULL").select("sub_code").distinct().join(counts, "sub_code", "left").na.fill(
        0, ["total_groups", "branded_groups", "total_brands", "eligible_brands"]
    )
    coverage = F.when(F.col("total_groups") > 0, F.bround(F.col("branded_groups") / F.col("total_groups"), 4)).otherwise(0.0)
    blocked = F.col("sub_code").isin(*vocab.BRAND_FILTER_BLOCKED)
    reason = (
        F.when(blocked, "blocked_category").when(F.col("total_groups") == 0, "no_visible_groups")
        .when(F.col("eligible_brands") < vocab.MIN_BRANDS, "insufficient_brands").when(F.col("coverage") < vocab.MIN_BRAND_COVERAGE, "insufficient_coverage")
    )
    decided = codes.withColumn("coverage", coverage).withColumn("reason", reason).withColumn("available", F.col("reason").isNull())
    zeroed = {c: F.when(blocked, 0).otherwise(F.col(c)) for c in ("total_groups", "branded_groups", "total_brands", "eligible_brands", "coverage")}
    return decided.withColumns(zeroed).withColumn("brands", F.when(F.col("available"), F.col("brands")).otherwise(""))


def category_tree_counts(products: DataFrame, mains: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Product counts of main categories, sub categories and sub categories with
    their children. `subs` has id, main_id, parent_id, code, label; `products`
    has id and sub_code."""
    per_code = products.filter("sub_code IS NOT NULL").groupBy(F.col("sub_code").alias("code")).agg(F.count_distinct("id").alias("_n"))
    own = subs.join(per_code, "code", "left").withColumn("products", F.coalesce("_n", F.lit(0))).drop("_n")
    by_main = mains.join(own.groupBy(F.col("main_id").alias("id")).agg(F.sum("products").alias("_p")), "id", "left").select(
        "id", "label", F.coalesce("_p", F.lit(0)).alias("products")
    )
    children = own.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.sum("products").alias("_c"))
    family = own.join(children, "id", "left").withColumn("products", F.col("products") + F.coalesce("_c", F.lit(0))).drop("_c")
    return by_main, own, family


# ---- matching of scraped rows -------------------------------------------------


def match_by_ean(staging: DataFrame, eans: DataFrame) -> DataFrame:
    """Staged rows with the product that has their barcode."""
    return staging.filter("ean_norm IS NOT NULL").join(eans.select("ean_norm", "product_id"), "ean_norm")


def prices_from_matches(matched: DataFrame, store_id: int, source: str, at) -> DataFrame:
    """Price rows of matched staging rows under one online store."""
    return matched.filter(F.col("price").isNotNull()).select(
        "product_id", F.lit(store_id).alias("store_id"), "price", F.lit(str(at)).cast("timestamp").alias("collected_at"), F.lit(source).alias("source")
    )


def union_matches(by_ean: DataFrame, manual: DataFrame) -> DataFrame:
    return by_ean.unionByName(manual)


def match_preview(staging: DataFrame, eans: DataFrame, manual_map: DataFrame, products: DataFrame) -> DataFrame:
    """Barcode matches, and mapped matches of rows without a barcode match,
    with the trigram similarity of the names."""
    side = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("size_text").alias("product_size"))
    fields = ["ext_id", F.col("name").alias("staged_name"), "ean_norm", F.col("size_text").alias("staged_size"), "product_id"]
    known = eans.select("ean_norm").distinct()
    by_ean = match_by_ean(staging, eans).select(*fields, F.lit("ean").alias("method"))
    manual = staging.join(known, "ean_norm", "left_anti").join(manual_map.select("ext_id", "product_id", "reason"), "ext_id").select(
        *fields, F.coalesce("reason", F.lit("manual")).alias("method")
    )
    both = union_matches(by_ean, manual).join(side, "product_id")
    grams = both.withColumns({"_a": trigrams(F.col("staged_name")), "_b": trigrams(F.col("product_name"))})
    scored = grams.withColumn("name_sim", set_similarity(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return scored.withColumn("name_ok", F.col("name_sim") >= NAME_MATCH)


def match_anomalies(preview: DataFrame) -> DataFrame:
    """Matches whose names differ or whose sizes do not agree."""
    return preview.filter(~F.col("name_ok") | ~blank_to_null("staged_size").eqNullSafe(blank_to_null("product_size")))


def unmatched_with_ean(staging: DataFrame, eans: DataFrame) -> DataFrame:
    return staging.filter("ean_norm IS NOT NULL").join(eans.select("ean_norm"), "ean_norm", "left_anti")


def unmatched_no_ean(staging: DataFrame) -> DataFrame:
    return staging.filter("ean_norm IS NULL")


def staging_tally(batch: DataFrame, staging: DataFrame, eans: DataFrame) -> DataFrame:
    """Rows of the batch, of the whole staging and of those with a match."""
    count = lambda df, kind: df.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "rows")
    matched = staging.filter("ean_norm IS NOT NULL").join(eans.select("ean_norm"), "ean_norm", "left_semi")
    return count(batch, "batch").unionByName(count(staging, "staging")).unionByName(count(matched, "matched"))


def best_hit(queries: DataFrame, titles: DataFrame, score: Column) -> DataFrame:
    """Best title per query among the titles found for it (query_id on both
    sides); the earlier position wins a tie."""
    joined = queries.join(titles, "query_id").withColumn("score", score)
    return pick_first(joined, "query_id", F.col("score").desc(), F.col("position").asc())


# ---- grouping and upkeep -------------------------------------------------------


def is_kg_produce() -> Column:
    """Loose produce sold by weight, told by its category and name."""
    low = F.lower("name")
    shapes = ("% kg%", "%, kg", "%kl kg%", "%kl., kg%", "% kg")
    return F.col("sub_code").like("produce_%") & reduce(lambda hit, p: hit | low.like(p), shapes, F.lit(False))


def build_groups(products: DataFrame, smallest: int = 2) -> tuple[DataFrame, DataFrame]:
    """Groups of products with the same canonical name and category, and their
    members. A group's number is its lowest member, so a rebuild keeps it and
    no global numbering is needed. Canonical names are made once and settled."""
    named = settled(products.select(F.col("id").alias("product_id"), canonical_name(F.col("name")).alias("canonical_name"), "sub_code"))
    groups = named.groupBy("canonical_name", "sub_code").agg(F.min("product_id").alias("group_id"), F.count("*").alias("member_count"))
    groups = groups.filter(F.col("member_count") >= smallest)
    return groups, named.join(groups, ["canonical_name", "sub_code"]).select("group_id", "product_id")


def group_preview(groups: DataFrame, limit: int = 30) -> DataFrame:
    return groups.orderBy(F.col("member_count").desc(), F.col("canonical_name"), F.col("sub_code")).limit(limit)


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count per named table."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def group_report(groups: DataFrame, members: DataFrame, products: DataFrame, largest: int = 10) -> DataFrame:
    """Largest groups with the distinct names of their members. Names are read
    for the largest groups only."""
    sizes = members.groupBy("group_id").agg(F.count("*").alias("member_count"))
    top = sizes.orderBy(F.col("member_count").desc(), F.col("group_id")).limit(largest)
    named = top.join(members, "group_id").join(products.select(F.col("id").alias("product_id"), "name"), "product_id")
    names = named.groupBy("group_id", "member_count").agg(F.array_sort(F.collect_set("name")).alias("member_names"))
    return names.join(groups.select(F.col("id").alias("group_id"), "canonical_name", "sub_code"), "group_id")


def category_conflicts(products: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members whose category is not their group's."""
    coded = groups.select(F.col("id").alias("group_id"), F.col("sub_code").alias("group_sub_code"))
    linked = members.select("group_id", F.col("product_id").alias("id")).join(products.select("id", "sub_code"), "id").join(coded, "group_id")
    return linked.filter(~F.col("sub_code").eqNullSafe(F.col("group_sub_code")))


def parsed_quantities(products: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Status of the quantity read from each member's name; a category conflict
    and a disagreement inside the group hold a value back. A group disagrees
    when its readable members give more than one quantity: told by comparing
    the lowest with the highest, without collecting the group."""
    coded = groups.select(F.col("id").alias("group_id"), F.col("sub_code").alias("group_sub_code"))
    linked = members.select("group_id", F.col("product_id").alias("id")).join(products.select("id", "name", "sub_code"), "id").join(coded, "group_id")
    parsed = linked.withColumn("_q", parse_quantity(F.col("name"))).select("*", "_q.*").drop("_q")
    clash = F.col("status").startswith("WOULD_SET") & ~F.col("sub_code").eqNullSafe(F.col("group_sub_code"))
    parsed = settled(parsed.withColumn("status", F.when(clash, "SKIP_CATEGORY_CONFLICT").otherwise(F.col("status"))))
    value = F.when(F.col("status").startswith("WOULD_SET"), F.struct("net_qty", "net_unit", "pack_count"))
    spread = parsed.groupBy("group_id").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    mixed = spread.filter(F.col("_low") != F.col("_high")).select("group_id", F.lit(True).alias("_mixed"))
    held = F.col("status").startswith("WOULD_SET") & F.col("_mixed").isNotNull()
    return parsed.join(mixed, "group_id", "left").withColumn("status", F.when(held, "SKIP_GROUP_CONFLICT").otherwise(F.col("status"))).drop("_mixed")


def quantity_conflicts(parsed: DataFrame) -> DataFrame:
    """Groups held back because their members disagree."""
    return parsed.filter(F.col("status") == "SKIP_GROUP_CONFLICT").select("group_id").distinct()


def class_report(rows: DataFrame, status: str = "status", order: str = "id", samples: int = 15) -> tuple[DataFrame, DataFrame]:
    """Rows per class and a few of each."""
    return rows.groupBy(status).agg(F.count("*").alias("rows")), top_n(rows, status, samples, F.col(order).asc(), rank="sample")


def catalog_health(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products, priced products and products with an image per chain."""
    priced = prices.select(F.col("product_id").alias("id")).distinct().withColumn("_priced", F.lit(True))
    return products.join(priced, "id", "left").groupBy("chain").agg(
        F.count("*").alias("total"), F.count("_priced").alias("with_price"), F.count(blank_to_null("image_url")).alias("with_image")
    )


def ungrouped(products: DataFrame, members: DataFrame) -> DataFrame:
    """Products outside all groups, per category."""
    loose = products.join(members.select(F.col("product_id").alias("id")).filter("id IS NOT NULL"), "id", "left_anti")
    return loose.groupBy("sub_code").agg(F.count("*").alias("cnt"))


def without_price(products: DataFrame, prices: DataFrame, limit: int = 5) -> DataFrame:
    """Categories with the most products that have no price at all."""
    bare = products.filter("sub_code IS NOT NULL").join(prices.select(F.col("product_id").alias("id")), "id", "left_anti")
    return bare.groupBy("sub_code").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), F.col("sub_code")).limit(limit)


def misplaced_products(products: DataFrame, prices: DataFrame, stores: DataFrame, chain: str, store_pattern: str) -> DataFrame:
    """Products of a chain priced only in stores whose name fits a pattern."""
    fits = F.lower("name").like(store_pattern.lower())
    shops = stores.select(F.col("id").alias("store_id"), fits.alias("_fits"))
    own = products.filter(F.col("chain") == chain).select("id")
    seen = prices.select(F.col("product_id").alias("id"), "store_id").join(own, "id", "left_semi").join(shops, "store_id")
    return seen.groupBy("id").agg(F.every("_fits").alias("_only")).filter("_only").select("id")


def scrape_freshness(products: DataFrame, as_of, column: str = "last_seen_utc") -> DataFrame:
    """Newest sighting per chain and the products seen in the last day."""
    at = F.lit(str(as_of)).cast(products.schema[column].dataType)
    recent = F.col(column) >= at - F.make_dt_interval(F.lit(1))
    return products.groupBy("chain").agg(
        F.max(column).alias("last_update"), F.count_if(recent).alias("updated_today"), F.count_if(F.col("sub_code").isNull()).alias("without_category")
    )


def new_users(users: DataFrame, as_of) -> DataFrame:
    """Live accounts in all, of the last day and of the last week."""
    at = F.lit(str(as_of)).cast(users.schema["created_at"].dataType)
    since = lambda days: F.count_if(F.col("created_at") >= at - F.make_dt_interval(F.lit(days)))
    return users.filter("deleted_at IS NULL").agg(F.count("*").alias("total"), since(1).alias("today"), since(7).alias("week"))


def gallery(products: DataFrame, missing: bool, text: str = "", newest: bool = True, limit: int = 100, at: str = "id") -> DataFrame:
    """Products without (or with) an image whose name or brand contains a text."""
    bare = blank_to_null("image_url").isNull()
    rows = products.filter(bare if missing else ~bare)
    if text.strip():
        rows = rows.filter(F.lower("name").contains(text.strip().lower()) | F.lower(F.coalesce("brand", F.lit(""))).contains(text.strip().lower()))
    order = F.col(at).desc_nulls_last() if newest else F.col(at).asc_nulls_last()
    return rows.orderBy(order, F.col("id")).limit(limit)


def favourites(picked: DataFrame, products: DataFrame, members: DataFrame, groups: DataFrame, rollup: DataFrame) -> DataFrame:
    """Favourite products of every user as display rows, newest first when
    sorted by `created_at`."""
    detail = product_detail(products, members, groups, rollup).withColumnRenamed("id", "product_id")
    return picked.join(detail, "product_id")


def my_selections(selections: DataFrame, n: int = 100) -> DataFrame:
    """The products a user picks most."""
    return top_n(selections, "user_id", n, F.col("count").desc(), F.col("last_used").desc_nulls_last(), F.col("product_id").asc(), rank="position")


def image_worklist(products: DataFrame, kind: str, host: str = "", hosted: str = "") -> DataFrame:
    """Products whose image needs work.

    missing    no image, scraped from the host
    unhosted   an image that is not on our own host yet
    by_ean     no image and a barcode of eight signs or more
    placeholder  an image address that stands for no image
    """
    bare = blank_to_null("image_url").isNull()
    if kind == "missing":
        return products.filter(bare & F.lower("source_url").contains(host.lower()))
    if kind == "unhosted":
        return products.filter(~bare & ~F.col("image_url").startswith(hosted))
    if kind == "by_ean":
        return products.filter(bare & (F.length(F.trim("ean")) >= 8))
    if kind == "placeholder":
        return products.filter(F.lower("image_url").rlike("placeholder|no-image|noimage|dummy|default"))
    raise ValueError(kind)


def orphan_source(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Best price-row address of products without image and address."""
    rank = F.when(F.col("source") == "prisma", 1).when(F.col("source") == "rimi", 2).when(F.col("source") == "selver", 3)
    orphans = products.filter(blank_to_null("image_url").isNull() & blank_to_null("source_url").isNull()).select(F.col("id").alias("product_id"))
    rows = prices.filter(F.col("source").isin("prisma", "rimi", "selver") & blank_to_null("source_url").isNotNull())
    return pick_first(rows.join(orphans, "product_id", "left_semi"), "product_id", rank, F.col("source_url"))


def ean_worklist(products: DataFrame, ext_map: DataFrame, prices: DataFrame, stores: DataFrame, chain: str, overwrite_bad: bool, bad: Column) -> DataFrame:
    """Products that need a barcode: those with a mapped page address first,
    then the others the chain sells."""
    empty = F.col("ean").isNull() | (F.col("ean") == "")
    lacking = products.filter(bad if overwrite_bad else empty).select("id", "name")
    mapped = ext_map.filter(F.col("ext_id").startswith("http")).groupBy(F.col("product_id").alias("id")).agg(F.min("ext_id").alias("url"))
    first = lacking.join(mapped, "id")
    shops = stores.filter(F.lower("chain") == chain.lower()).select(F.col("id").alias("store_id"))
    sold = prices.join(shops, "store_id", "left_semi").select(F.col("product_id").alias("id")).distinct()
    second = lacking.join(sold, "id", "left_semi").join(mapped, "id", "left_anti").withColumn("url", F.lit(None).cast("string"))
    return first.unionByName(second)


def products_by_host(products: DataFrame, host: str, n: int | None = None, at: str = "last_seen_utc") -> DataFrame:
    """Products scraped from a host, newest seen first."""
    rows = products.filter(F.lower("source_url").contains(host.lower())).orderBy(F.col(at).desc_nulls_last(), F.col("id"))
    return rows if n is None else rows.limit(n)


