"""Prices written as text or in minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.common import let

MONEY = "decimal(18,2)"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _euros(whole: Column, cents: Column) -> Column:
    return F.concat(whole, F.lit("."), F.rpad(cents, 2, "0")).try_cast(MONEY)


def parse_price_text(raw: Column, variant: str = "card") -> Column:
    """Price of a text under one of four rules.

    card    "3€49", "3,49", "3 49", and three or more bare digits as cents; a
            percentage is no price
    spaced  "1 99" is 1.99, otherwise the plain number with comma or dot
    shop    a number with two decimals, else a whole number before EUR
    first   the first number in the text
    """
    text = F.trim(F.replace(F.coalesce(raw, F.lit("")), F.lit("\u00a0"), F.lit(" ")))
    if variant == "card":
        def read(t: Column) -> Column:
            bare = F.regexp_replace(t, r"[^\d]", "")
            with_sign = r"(\d[\d\s]*)€\s*(\d{1,2})"
            return F.when(~t.rlike(r"^\d+\s*%+$"), F.coalesce(
                _euros(F.nullif(F.regexp_replace(F.regexp_extract(t, with_sign, 1), r"\D", ""), F.lit("")), _group(t, with_sign, 2)),
                _euros(_group(t, r"(\d+)[,.](\d{1,2})", 1), _group(t, r"(\d+)[,.](\d{1,2})", 2)),
                _euros(_group(t, r"(\d+)\s+(\d{2})", 1), _group(t, r"(\d+)\s+(\d{2})", 2)),
                F.when(F.length(bare) > 2, (bare.try_cast("decimal(18,0)") / 100).cast(MONEY)),
            ))

        return let(text, read)
    if variant == "spaced":
        joined = F.replace(text, F.lit(" "), F.lit(""))
        split = text.contains(" ") & joined.rlike(r"^\d{3,}$")
        return F.when(split, (joined.try_cast("decimal(18,0)") / 100).cast(MONEY)).otherwise(
            F.replace(text, F.lit(","), F.lit(".")).try_cast("double").cast(MONEY)
        )
    dotted = F.replace(text, F.lit(","), F.lit("."))
    if variant == "shop":
        return F.coalesce(_group(dotted, r"(\d+\.\d{2})", 1), _group(dotted, r"(\d+)\s*EUR", 1)).try_cast(MONEY)
    if variant == "first":
        return _group(dotted, r"(\d+(?:\.\d*)?)", 1).try_cast("decimal(18,6)").cast(MONEY)
    raise ValueError(variant)


def minor_to_major(value: Column, variant: str, is_whole: Column) -> Column:
    """Major units of a raw amount; `is_whole` tells whether the source wrote
    it without decimals.

    cents     whole amounts are cents, others only above 100
    over_100  only whole amounts above 100 are cents; others from 100 on
    digits    amounts from 100 on without a decimal sign are cents
    """
    if variant == "cents":
        minor = is_whole | (value > 100)
    elif variant == "over_100":
        minor = (is_whole & (value > 100)) | (~is_whole & (value >= 100))
    elif variant == "digits":
        minor = is_whole & (value >= 100)
    else:
        raise ValueError(variant)
    return F.when(minor, F.round(value / 100.0, 2)).otherwise(value)


def is_unit_price(text: Column) -> Column:
    """Whether a price text names a unit (a slash is enough)."""
    return F.coalesce(text, F.lit("")).contains("/")
