"""What a product text says about its identity: traits, hard checks that must
agree and downgrade tags. Rules come from the vocabulary; a check is only
evaluated for the categories that list it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.common import blank_to_null
from cartwise.functions import vocab
from cartwise.functions.names import contains_any, matches_any


def identity_text(canonical: Column, sample: Column, brand: Column) -> Column:
    """All naming signals of a group in one text."""
    return F.concat_ws(" ", *[blank_to_null(c) for c in (canonical, sample, brand)])


def _by_words(table: dict) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(*[F.when(contains_any(text, words), value) for value, words in table.items()])


def _by_patterns(table: dict) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(*[F.when(matches_any(text, patterns), value) for value, patterns in table.items()])


def _tags(table: dict, words: bool = False) -> Callable[[Column], Column]:
    test = contains_any if words else matches_any
    return lambda text: F.array_compact(F.array(*[F.when(test(text, rules), tag) for tag, rules in table.items()]))


def percent(text: Column) -> Column:
    """Percentage in a text; a range counts as its middle."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    span = r"(\d+[.,]?\d*)\s*-\s*(\d+[.,]?\d*)\s*%"
    number = lambda pattern, group: F.nullif(F.regexp_extract(dotted, pattern, group), F.lit("")).try_cast("double")
    return F.when(dotted.rlike(span), (number(span, 1) + number(span, 2)) / 2).otherwise(number(r"(\d+[.,]?\d*)\s*%", 1))


def _flavour_state(text: Column) -> Column:
    every = [p for patterns in vocab.FLAVOUR_VARIANT.values() for p in patterns]
    return F.when(contains_any(text, vocab.FLAVOUR_WORDS) | matches_any(text, every), "flavored").otherwise("plain")


def _milk_fat(text: Column) -> Column:
    half = F.bround(percent(text) * 2, 0) / 2
    return F.when(half.isNotNull(), F.concat(F.lit("pct_"), F.format_string("%.1f", half)))


def _yogurt_fat(text: Column) -> Column:
    pct = percent(text)
    return (
        F.when(pct >= 6.0, "greek_high_fat").when(pct >= 2.0, "standard").when(pct >= 0.5, "low_fat").when(pct.isNotNull(), "fat_free")
    )


HARD: dict[str, Callable[[Column], Column]] = {
    "flavour_state": _flavour_state,
    "fat_class_milk": _milk_fat,
    "fat_class_yogurt": _yogurt_fat,
    "yogurt_form": lambda text: F.coalesce(_by_words(vocab.YOGURT_FORM)(text), F.lit("regular")),
    "animal_type": _by_patterns(vocab.ANIMAL_TYPE),
    "caffeine_state": _by_words(vocab.CAFFEINE),
    "cut_type": _by_words(vocab.CUT_TYPE),
    "cheese_type": _by_words(vocab.CHEESE_TYPE),
    "cheese_form": lambda text: F.coalesce(_by_words(vocab.CHEESE_FORM)(text), F.lit("block")),
    "fish_species": _by_words(vocab.FISH_SPECIES),
    "nut_seed_type": _by_words(vocab.NUT_SEED_TYPE),
    "beverage_type": _by_words(vocab.BEVERAGE_TYPE),
    "meat_form": _by_words(vocab.MEAT_FORM),
}

DOWNGRADE: dict[str, Callable[[Column], Column]] = {
    "flavour_profile": _tags(vocab.FLAVOUR_PROFILE),
    "flavour_variant": _tags(vocab.FLAVOUR_VARIANT),
    "cheese_modifier": _tags(vocab.CHEESE_MODIFIER),
    "dessert_addon": _tags(vocab.DESSERT_ADDON),
    "oil_grade": lambda text: F.slice(_tags(vocab.OIL_GRADE)(text), 1, 1),
    "protein_enriched": _tags(vocab.PROTEIN_ENRICHED),
    "grain_type": _tags(vocab.GRAIN_TYPE),
    "coffee_brew_form": _tags(vocab.COFFEE_BREW_FORM),
    "coffee_product_line": _tags(vocab.COFFEE_PRODUCT_LINE),
}


def required_traits(text: Column) -> Column:
    """Traits a substitute must have as well."""
    return _tags(vocab.REQUIRED_TRAITS, words=True)(F.lower(text))


def identity_traits(text: Column) -> Column:
    """Traits that must be the same on both sides."""
    return _tags(vocab.IDENTITY_TRAITS, words=True)(F.lower(text))


def _categories(rules: dict, check: str) -> list[str]:
    return [code for code, names in rules.items() if check in names]


def hard_values(sub_code: Column, text: Column) -> Column:
    """Value of every hard check in registry order; NULL where it is unknown
    or where the category does not list the check."""
    low = F.lower(text)
    return F.array(*[
        F.when(sub_code.isin(*_categories(vocab.HARD_CHECKS, name)), check(low)).cast("string") for name, check in HARD.items()
    ])


def _named(check: str, tags: Column) -> Column:
    return F.transform(tags, lambda tag: F.concat(F.lit(check + ":"), tag))


def downgrade_tags(sub_code: Column, text: Column) -> Column:
    """Tags of the category's downgrade checks, each with its check's name, so
    that equal arrays mean equal sets under every check."""
    low = F.lower(text)
    none = F.array().cast("array<string>")
    return F.concat(*[
        F.when(sub_code.isin(*_categories(vocab.DOWNGRADE_CHECKS, name)), _named(name, check(low))).otherwise(none)
        for name, check in DOWNGRADE.items()
    ])


def hard_ok(sub_code: Column, original: Column, candidate: Column) -> Column:
    """Every known value of the original is the candidate's value too. On a
    flavoured milk the fat class does not count."""
    differs = F.exists(
        F.arrays_zip(original.alias("o"), candidate.alias("c")),
        lambda pair: pair["o"].isNotNull() & ~pair["o"].eqNullSafe(pair["c"]),
    )
    flavoured_milk = (sub_code == "dairy_milk") & F.get(original, F.lit(0)).eqNullSafe("flavored")
    return F.when(flavoured_milk, F.get(candidate, F.lit(0)).eqNullSafe("flavored")).otherwise(~differs)


def traits_ok(o_required: Column, c_required: Column, o_identity: Column, c_identity: Column) -> Column:
    """The candidate keeps every required trait and shares the identity ones."""
    return (F.size(F.array_except(o_required, c_required)) == 0) & (F.array_sort(o_identity) == F.array_sort(c_identity))
