"""Package sizes and quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.common import let, literal_map
from cartwise.functions import vocab
from cartwise.functions.names import collapse

QTY = "decimal(18,3)"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(18,6)")


def _base_qty(qty: Column, unit: Column) -> Column:
    return (qty * F.when(F.lower(unit).isin("kg", "l"), 1000).otherwise(1)).cast(QTY)


def _base_unit(unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low == "kg", "g").when(low == "l", "ml").otherwise(low)


def normalize_unit(raw: Column) -> Column:
    """Base unit and factor of a unit; NULL when the unit is not known."""
    unit = F.lower(F.trim(raw))
    base = literal_map({k: v[0] for k, v in vocab.UNITS.items()})
    factor = literal_map({k: v[1] for k, v in vocab.UNITS.items()})
    return F.when(base[unit].isNotNull(), F.struct(base[unit].alias("unit"), factor[unit].alias("factor")))


def sane_qty(qty: Column) -> Column:
    """Quantity above zero and not beyond the largest sensible one."""
    return F.when((qty > 0) & (qty <= vocab.MAX_QUANTITY), qty)


def effective_qty(qty: Column, pack: Column) -> Column:
    """Quantity times pack count; a pack count that makes no sense is one."""
    return sane_qty(qty) * F.coalesce(sane_qty(pack), F.lit(1))


def size_from_name(name: Column) -> Column:
    """First pack size of a name as `N×Q unit`, else its first single size."""
    text = collapse(F.coalesce(name, F.lit("")))
    pack = r"(?iU)(\d+)\s*[x×]\s*(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b"
    single = r"(?iU)(\d+[.,]?\d*)\s*(ml|l|g|kg|cl|dl|tk|pcs)\b"
    dotted = lambda p, g: F.replace(_group(text, p, g), F.lit(","), F.lit("."))
    packed = F.concat(_group(text, pack, 1), F.lit("×"), dotted(pack, 2), F.lit(" "), F.lower(_group(text, pack, 3)))
    alone = F.concat(dotted(single, 1), F.lit(" "), F.lower(_group(text, single, 2)))
    return F.replace(F.coalesce(packed, alone, F.lit("")), F.lit(" pcs"), F.lit(" tk"))


def parse_size_text(size: Column) -> Column:
    """Pack count, quantity in the base unit and the pack text of a size field
    that holds nothing else; NULL when it holds anything else."""
    pack = r"(?iU)^\s*(\d+)\s*[x×]\s*([\d.,]+)\s*(ml|l|g|kg)\s*$"
    single = r"(?iU)^\s*([\d.,]+)\s*(ml|l|g|kg)\s*$"
    packs = _group(size, pack, 1)
    qty = _number(F.coalesce(_group(size, pack, 2), _group(size, single, 1)))
    unit = F.coalesce(_group(size, pack, 3), _group(size, single, 2))
    return F.when(
        qty.isNotNull() & unit.isNotNull(),
        F.struct(
            F.coalesce(packs.try_cast("long"), F.lit(1).cast("long")).alias("pack_count"), _base_qty(qty, unit).alias("net_qty"),
            _base_unit(unit).alias("net_unit"), F.when(packs.isNotNull(), F.trim(size)).alias("pack_pattern"),
        ),
    )


def parse_quantity(name: Column) -> Column:
    """Status and quantity read from a product name.

    The rules in order: priced by the kilogram (the name ends in a bare kg), a
    pack whose decimal sign was lost ("10 X 12 5 G"), a pack, a single size. A
    single size below 15 that is no known portion is left for review.
    """
    broken = r"(?iU)\d+\s*[x×*]\s*\d+\s+\d\s*(?:kg|g|l|ml)\b"
    multi = r"(?iU)\d+\s*[x×*]\s*\d+[.,]?\d*\s*(?:kg|g|l|ml)\b"
    single = r"(?iU)\d+[.,]?\d*\s*(?:kg|g|l|ml)\b"
    bare_kg = r"(?iU)(?<![\d.,])\s*kg\s*$"
    name = F.coalesce(name, F.lit(""))
    hits = F.struct(
        *[F.regexp_extract(name, pattern, 0).alias(kind) for kind, pattern in (("broken", broken), ("multi", multi), ("single", single))],
        name.rlike(bare_kg).alias("bare"),
    )

    def read(h: Column) -> Column:
        text = F.coalesce(F.nullif(h["broken"], F.lit("")), F.nullif(h["multi"], F.lit("")), h["single"])
        lost = F.regexp_replace(F.regexp_extract(text, r"(\d+\s+\d)\s*[A-Za-z]+$", 1), r"\s+", ".")
        qty = F.when(h["broken"] != "", lost).otherwise(F.regexp_extract(text, r"(\d+[.,]?\d*)\s*[A-Za-z]+$", 1))
        kind = (
            F.when(h["bare"] & (h["multi"] == "") & ~h["single"].rlike("(?i)kg$"), "SKIP_KG_PRICED")
            .when(h["broken"] != "", "WOULD_SET_MULTIPACK_RECOVERED_DECIMAL").when(h["multi"] != "", "WOULD_SET_MULTIPACK")
            .when(h["single"] != "", "WOULD_SET_SINGLE").otherwise("SKIP_UNPARSEABLE")
        )
        packs = F.coalesce(_group(text, r"^(\d+)\s*[x×*X]", 1), F.lit("1"))
        return F.struct(kind.alias("kind"), _number(qty).alias("qty"), F.regexp_extract(text, r"([A-Za-z]+)$", 1).alias("unit"), packs.try_cast("long").alias("packs"))

    def judge(r: Column) -> Column:
        base = _base_qty(r["qty"], r["unit"])
        tiny = (r["kind"] == "WOULD_SET_SINGLE") & (base < 15) & ~F.floor(base).isin(8, 10, 12, 14)
        kept = r["kind"].startswith("WOULD_SET") & ~tiny
        return F.struct(
            F.when(tiny, "SKIP_AMBIGUOUS_SMALL_QTY").otherwise(r["kind"]).alias("status"), F.when(kept, base).alias("net_qty"),
            F.when(kept, _base_unit(r["unit"])).alias("net_unit"), F.when(kept, r["packs"]).alias("pack_count"),
        )

    return let(let(hits, read), judge)


def size_from_description(text: Column) -> Column:
    """Size line of a dish description."""
    return F.trim(F.coalesce(_group(text, r"Suurus,?\s*maht[:\s]+([^\n]+)", 1), F.lit("")))


def size_in_name(name: Column) -> Column:
    """Whether a name already shows a size."""
    return name.rlike(
        r"(?iU)\b\d+(?:[.,]\d+)?\s*(?:ml|cl|dl|l|g|kg)\b|\b\d+\s*[x*]\s*\d+(?:[.,]\d+)?\s*(?:ml|cl|dl|l|g|kg)\b"
    )
