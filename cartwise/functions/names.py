"""Names and other free text as column expressions. Patterns that meet
Estonian letters carry (?U), without which Java's word classes are ASCII."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.common import blank_to_null, let
from cartwise.functions import vocab

SPACES = " \t\r\n\f"


def contains_any(text: Column, words) -> Column:
    return reduce(lambda hit, word: hit | text.contains(word), words, F.lit(False))


def matches_any(text: Column, patterns) -> Column:
    return text.rlike("(?U)(?:" + "|".join(patterns) + ")")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unaccent(text: Column) -> Column:
    return F.translate(text, "äöõüšžÄÖÕÜŠŽ", "aoouszAOOUSZ")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(unaccent(text)), r"[^a-z0-9]+", "-"), F.lit("-"))


def key_norm(text: Column) -> Column:
    """Trimmed lower-case key without Estonian letters."""
    return unaccent(F.lower(F.trim(F.coalesce(text, F.lit("")))))


def canonical_name(name: Column) -> Column:
    """Grouping key of a product name: lower case, no chain prefix, no size or
    class endings, single spaces. Endings are removed in three passes, which a
    stable name leaves as it is."""
    text = F.lower(F.btrim(name, F.lit(SPACES)))
    for prefix in vocab.CHAIN_PREFIXES:
        text = F.regexp_replace(text, "(?iU)" + prefix, "")
    for _ in range(3):
        for ending in vocab.NAME_ENDINGS:
            text = F.btrim(F.regexp_replace(text, "(?iU)" + ending, ""), F.lit(SPACES))
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(SPACES))


def strip_own_brand(name: Column, path: Column, prefix: str = "Coop ") -> Column:
    """Drop a wrong own-brand prefix on the listed category paths, unless the
    second word shows that the brand is real."""
    rest = F.substring(name, len(prefix) + 1, 1 << 30)
    second = F.lower(F.get(F.split(F.ltrim(rest), r"\s+"), F.lit(0)))
    wrong = name.startswith(prefix) & contains_any(path, vocab.OWN_BRAND_PATHS) & ~second.isin(*vocab.OWN_BRAND_SECOND_WORDS)
    return F.when(wrong, rest).otherwise(name)


def repair_encoding(name: Column) -> Column:
    """Put lost Estonian letters back; names with a protected word stay."""
    fixed = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), vocab.ENCODING_REPAIRS, name)
    return F.when(contains_any(F.lower(name), vocab.ENCODING_SKIP_WORDS), name).otherwise(fixed)


def _clean_maker(raw: Column, longest: int) -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")))
    text = F.regexp_replace(text, r"(?iU)^\s*(tootja|manufacturer|producer|valmistaja)\b\s*[:\-]?\s*", "")
    text = F.trim(F.regexp_replace(text, r"(?iU)^\s*(kaubam[aä]rk|brand|br[äa]nd)\b\s*[:\-]?\s*", ""))
    return let(text, lambda t: (
        F.when(t == "", "")
        .when(key_norm(t).isin(*vocab.UNSET_BRANDS), vocab.UNSET_LABEL)
        .when(t.contains(":") | t.contains("\n") | ~F.length(t).between(2, longest), "")
        .when(~t.rlike("[A-Za-zÄÖÜÕäöüõŠšŽž]") | contains_any(F.lower(t), vocab.BAD_BRAND_WORDS), "")
        .otherwise(t)
    ))


def clean_brand(raw: Column) -> Column:
    """Brand without its label; an 'unspecified' spelling becomes the standard
    one, anything that cannot be a brand becomes empty."""
    return _clean_maker(raw, 50)


def clean_manufacturer(raw: Column) -> Column:
    return _clean_maker(raw, 80)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or more that are neither
    numbers nor stop words, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"(?U)^\d+$") & ~w.isin(*vocab.STOP_TOKENS))
    return F.array_sort(F.array_distinct(kept))


def title_matches(title: Column, name: Column, brand: Column, amount: Column) -> Column:
    """A page title shows the wanted product: one word of the name and two of
    name, brand or amount, or any word of the brand."""
    shown = tokens(title)
    wanted = F.array_distinct(F.concat(tokens(name), tokens(brand), tokens(amount)))
    overlap = lambda words: F.size(F.array_intersect(words, shown))
    return ((overlap(tokens(name)) >= 1) & (overlap(wanted) >= 2)) | (overlap(tokens(brand)) >= 1)


def hit_score(query: Column, brand: Column, amount: Column, title: Column) -> Column:
    """One point per distinct query word of three letters found in the title,
    two for the brand, one for the amount."""
    text = F.lower(F.coalesce(title, F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))
    named = F.size(F.filter(words, lambda w: (F.length(w) >= 3) & text.contains(w)))
    extra = lambda part, points: F.when(text.contains(F.lower(blank_to_null(part))), points).otherwise(0)
    return (named + extra(brand, 2) + extra(amount, 1)).cast("double")


def choose_name(candidates: Column, leaf: Column, bad_names: tuple[str, ...] = ()) -> Column:
    """First candidate that is not blank, not a known bad name and not the
    category itself; failing that, the first candidate."""
    norm = lambda c: F.lower(F.trim(c))
    good = F.filter(
        F.transform(candidates, lambda c: F.trim(F.coalesce(c, F.lit("")))),
        lambda c: (c != "") & ~norm(c).isin(*(bad_names or ("",))) & ~norm(c).eqNullSafe(norm(leaf)),
    )
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.get(candidates, F.lit(0)), F.lit(""))


def join_crumbs(crumbs: Column) -> Column:
    """Breadcrumb path without repeats of the crumb before."""
    norm = lambda c: F.lower(F.trim(c))
    filled = F.filter(crumbs, lambda c: F.trim(c) != "")
    kept = F.filter(filled, lambda c, i: (i == 0) | (norm(c) != norm(F.get(filled, i - 1))))
    return F.array_join(kept, " / ")


def produce_family(name: Column) -> Column:
    """Family of the highest priority whose stem occurs in the name; NULL when
    none does or two families tie."""
    text = F.lower(name)
    hits = F.array_compact(F.array(*[
        F.when(contains_any(text, stems), F.struct(F.lit(priority).alias("priority"), F.lit(family).alias("family")))
        for family, stems, priority in vocab.PRODUCE_FAMILIES
    ]))
    def winner(found: Column) -> Column:
        top = F.array_max(F.transform(found, lambda h: h["priority"]))
        best = F.filter(found, lambda h: h["priority"] == top)
        return F.when(F.size(best) == 1, F.get(best, F.lit(0))["family"])

    return let(hits, winner)


def infer_city(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    city = F.when(low.startswith("pär"), "parnu")
    for name, words in vocab.CITY_WORDS.items():
        city = city.when(contains_any(low, words), name)
    return city.otherwise(vocab.DEFAULT_CITY)


def _labelled(specs: Column, word: str) -> Column:
    """First filled value whose label contains a word."""
    hits = F.map_filter(specs, lambda k, v: F.lower(k).contains(word) & (F.trim(v) != ""))
    return F.try_element_at(F.map_values(hits), F.lit(1))


def guess_brand(json_brand: Column, json_maker: Column, specs: Column, title: Column) -> Column:
    """Brand from structured data, then from labelled specifications in the
    order of the labels, then a title part written mostly in capitals."""
    labelled = [_labelled(specs, word) for word in vocab.BRAND_LABELS]
    letters = lambda p: F.regexp_replace(p, "[^A-Za-zÅÄÖÕÜŠŽåäöõüšž]", "")
    capitals = lambda p: F.length(F.regexp_replace(letters(p), "[^A-ZÅÄÖÕÜŠŽ]", ""))
    parts = F.transform(F.split(F.coalesce(title, F.lit("")), r"[,-]+"), lambda p: collapse(p))
    loud = F.filter(parts, lambda p: (F.length(letters(p)) >= 2) & (capitals(p) >= F.length(letters(p)) * 0.7))
    return F.coalesce(
        blank_to_null(json_brand), blank_to_null(json_maker), *[F.trim(v) for v in labelled], F.try_element_at(loud, F.lit(1)), F.lit("")
    )


def leading_brand(name: Column) -> Column:
    """First word of the name as a brand guess, 2 to 24 letters."""
    word = F.regexp_replace(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)), r"(?U)[^\w\-’'`]+", "")
    return F.when(F.length(word).between(2, 24), word)


def translate_measure(measure: Column) -> Column:
    """Measure words replaced one after another as whole words."""
    text = F.trim(F.coalesce(measure, F.lit("")))
    for word, local in vocab.MEASURES.items():
        text = F.regexp_replace(text, rf"(?iU)\b{re.escape(word)}\b", local)
    return text


def translate_ingredient(name: Column) -> Column:
    """Store word of an ingredient: exact entry, else the first entry that the
    name contains, else the name."""
    low = F.lower(F.trim(name))
    exact = reduce(lambda c, kv: c.when(low == kv[0], kv[1]), list(vocab.INGREDIENTS.items())[1:], F.when(low == "chicken", vocab.INGREDIENTS["chicken"]))
    inside = reduce(
        lambda c, kv: c.when(low.contains(kv[0]), kv[1]), list(vocab.INGREDIENTS.items())[1:],
        F.when(low.contains("chicken"), vocab.INGREDIENTS["chicken"]),
    )
    return F.coalesce(exact, inside, name)


def plausible_product(name: Column, price: Column, ean: Column, brand: Column, maker: Column) -> Column:
    """Whether a scraped row can be a product. With a barcode any name that is
    not noise will do; without one it needs a price and a size, a maker or a
    name of two words."""
    made = blank_to_null(brand).isNotNull() | blank_to_null(maker).isNotNull()
    coded, priced = blank_to_null(ean).isNotNull(), F.coalesce(price > 0, F.lit(False))

    def judge(low: Column) -> Column:
        words = F.size(F.split(low, r"\s+"))
        noise = (
            (low == "") | low.isin(*vocab.NOISE_EXACT, *vocab.NOISE_PLACES) | contains_any(low, vocab.NOISE_CONTAINED)
            | reduce(lambda hit, p: hit | low.startswith(p), vocab.NOISE_PREFIXES, F.lit(False))
            | ((words == 1) & (F.length(low) <= 6))
        )
        sized = low.rlike(r"(?iU)\b\d+[,.]?\d*\s?(?:kg|g|l|ml|tk|pcs|x|×)\s?\d*\b")
        named = (F.length(low) >= 6) & (words >= 2)
        return ~noise & (coded | (priced & (sized | made | named)))

    return let(F.lower(F.trim(F.coalesce(name, F.lit("")))), judge)


def plausible_address(line: Column) -> Column:
    """A line that can be a street address."""
    street = line.rlike(rf"(?iU)\b(?:{'|'.join(vocab.ADDRESS_WORDS)})\b")
    return F.coalesce(
        ~line.contains("@") & ~line.rlike(r"^[0-9\s]+$") & F.length(line).between(8, 140) & line.rlike(r"\d") & street, F.lit(False)
    )


def clean_store_name(name: Column) -> Column:
    """Store name without opening hours, city prefix or doubled spaces; the
    bare chain name and the online shop become empty."""
    text = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)\s+(?:E[-–]?P|E[-–]?[A-Z](?:\s*\d)?)\b.*$", ""))
    def shortened(t: Column) -> Column:
        rest = F.trim(F.regexp_extract(t, r"(?i)^(?:Tallinn|Tartu)\s+(.*)$", 1))
        return F.regexp_replace(F.when(F.lower(rest).contains("selver") & (F.lower(rest) != "selver"), rest).otherwise(t), r"\s{2,}", " ")

    def named(t: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(t, vocab.STORE_NAME, 1), F.lit("")), t)

    final = lambda t: F.when(t.rlike(r"(?i)^(?:e-?Selver|Selver)$|\be-?selver\b"), "").otherwise(F.trim(t))
    return let(let(let(text, shortened), named), final)
