"""Barcodes, external ids, URLs and pseudonyms as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.common import blank_to_null, let
from cartwise.functions import vocab
from cartwise.functions.names import slug

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # Fixed value: RFC 4122 URL namespace


def digits(column: Column) -> Column:
    return F.regexp_replace(column, r"[^0-9]", "")


def is_valid_ean13(code: Column) -> Column:
    """Thirteen digits whose check digit fits."""
    places = F.transform(F.split(F.substring(code, 1, 12), ""), lambda d, i: d.try_cast("int") * F.when(i % 2 == 0, 1).otherwise(3))
    total = F.aggregate(places, F.lit(0), lambda s, d: s + d)
    return F.coalesce(
        code.rlike(r"^[0-9]{13}$") & ((10 - total % 10) % 10 == F.substring(code, 13, 1).try_cast("int")), F.lit(False)
    )


def normalize_ean(raw: Column, variant: str = "digits") -> Column:
    """Barcode digits under one of four rules.

    digits    all digits, empty is NULL
    staging   8, 12, 13 or 14 digits; 12 gain a leading zero, a GTIN-14 that
              starts with 0 loses it
    logistic  a GTIN-14 that starts with 0 or 1 loses it, 12 gain a zero, and
              only 8 or 13 digits remain
    checked   prefixes are dropped or added only when the check digit of the
              result fits; otherwise the digits stay as they are
    """
    d = F.nullif(digits(raw), F.lit(""))
    if variant == "digits":
        return d
    if variant in ("staging", "logistic"):
        lead, kept = ("0", "8}|[0-9]{13}|[0-9]{14") if variant == "staging" else ("[01]", "8}|[0-9]{13")
        cut = F.regexp_replace(d, f"^{lead}([0-9]{{13}})$", "$1")
        padded = F.regexp_replace(cut, "^([0-9]{12})$", "0$1")
        return F.nullif(F.regexp_extract(padded, f"^([0-9]{{{kept}}})$", 1), F.lit(""))
    if variant == "checked":
        return let(d, lambda c: (
            F.when(c.rlike("^[01][0-9]{13}$") & is_valid_ean13(c.substr(2, 13)), c.substr(2, 13))
            .when(c.rlike("^[0-9]{12}$") & is_valid_ean13(F.concat(F.lit("0"), c)), F.concat(F.lit("0"), c))
            .otherwise(c)
        ))
    raise ValueError(variant)


def is_bogus_ean(code: Column) -> Column:
    """Eight equal digits or all zeros."""
    return F.coalesce(code.rlike(r"^([0-9])\1{7}$") | (code == "0000000000000"), F.lit(False))


def is_bad_ean(code: Column) -> Column:
    """No usable barcode: missing, not 8 or 13 digits, or bogus."""
    return code.isNull() | ~code.rlike(r"^(?:[0-9]{8}|[0-9]{13})$") | is_bogus_ean(code)


def pick_barcode(gtins: Column, specs: Column, image: Column) -> Column:
    """First value of 8 to 14 digits among the gtin keys of a map, then the
    barcode labels of a map, then the image file name. A stock number never
    counts as a barcode."""
    sized = lambda v: F.length(digits(v)).between(8, 14)
    from_keys = [F.when(sized(gtins[k]), gtins[k]) for k in vocab.GTIN_KEYS]
    labelled = F.filter(
        F.map_values(F.map_filter(specs, lambda k, v: _any_word(F.lower(k), vocab.BARCODE_LABELS) & sized(v))), lambda v: v.isNotNull()
    )
    return F.trim(F.coalesce(*from_keys, F.try_element_at(labelled, F.lit(1)), F.nullif(F.regexp_extract(image, r"/(\d{8,14})_kuva", 1), F.lit(""))))


def _any_word(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def canonical_url(url: Column, hosts: list[str] | None = None, strip_prefix: str | None = None) -> Column:
    """URL without query, fragment, `:line:col` tail and closing slash; NULL
    for a host outside the list. `strip_prefix` is a leading path to drop."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    if strip_prefix:
        path = F.when(path.startswith(strip_prefix + "/"), F.substring(path, len(strip_prefix) + 1, 1 << 30)).otherwise(path)
    path = F.rtrim(F.regexp_replace(path, r":\d+(?::\d+)?$", ""), F.lit("/"))
    clean = F.concat(scheme, F.lit("://"), host, path)
    kept = F.lower(host).isin(*hosts) if hosts else host != ""
    return F.when(kept, clean)


def id_from_url(url: Column) -> Column:
    """Product number after `/p/` or at the end, else the last 120 characters
    of the URL as a slug."""
    number = F.coalesce(_nonempty(F.regexp_extract(url, r"/p/(\d+)", 1)), _nonempty(F.regexp_extract(url, r"-(\d+)$", 1)))
    slugged = F.btrim(F.regexp_replace(url, r"[^a-zA-Z0-9]+", "-"), F.lit("-"))
    return F.coalesce(number, F.right(slugged, F.lit(120)))


def _nonempty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def external_id(kind: str, **c: Column) -> Column:
    """Stable key of a marketplace item.

    gtin     the barcode, else `iid:<24 hex id>`, else NULL    (ean, item_id)
    item     `wolt:<id>`, else `wolt:` and 16 hex of the md5 of host and name
                                                      (item_id, host, name)
    venue    `bolt:<venue>:<id>`, else slugs of name and size
                                                (venue, item_id, name, size)
    """
    item = _nonempty(F.trim(c["item_id"]))
    if kind == "gtin":
        lowered = F.lower(item)
        return F.coalesce(_nonempty(c["ean"]), F.when(lowered.rlike("^[0-9a-f]{24}$"), F.concat(F.lit("iid:"), lowered)))
    if kind == "item":
        hashed = F.substring(F.md5(F.concat(c["host"], F.lit("|"), F.coalesce(c["name"], F.lit("")))), 1, 16)
        return F.concat(F.lit("wolt:"), F.coalesce(item, hashed))
    if kind == "venue":
        size = _nonempty(F.substring(slug(F.coalesce(c["size"], F.lit(""))), 1, 20))
        named = F.concat_ws(":", F.substring(slug(c["name"]), 1, 40), size)
        return F.concat(F.lit("bolt:"), c["venue"], F.lit(":"), F.coalesce(item, named))
    raise ValueError(kind)


def cdn_image_url(kind: str, value: Column, base: str) -> Column:
    """Image address built from a product number in a URL (`id`) or from a
    barcode whose first two digits name the folders (`ean`)."""
    if kind == "id":
        number = _nonempty(F.regexp_extract(value, r"/p/(\d+)", 1))
        return F.when(number.isNotNull(), F.concat(F.lit(base), number))
    code = F.trim(value)
    return F.when(
        F.length(code) >= 2,
        F.concat(F.lit(base + "/"), F.substring(code, 1, 1), F.lit("/"), F.substring(code, 2, 1), F.lit("/"), code, F.lit(".jpg")),
    )


def device_key(raw: Column, secret: str) -> Column:
    """HMAC-SHA256 of a device id in hex; NULL for blank ids or no secret, so
    a raw id is never kept. Spark has no HMAC, so it is two SHA-256 passes over
    the padded key, which is prepared once on the driver."""
    if not secret:
        return F.lit(None).cast("string")
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner_pad, outer_pad = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    text = blank_to_null(raw)
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner_pad)), F.encode(text, "UTF-8")), 256))
    return F.when(text.isNotNull(), F.sha2(F.concat(F.lit(bytearray(outer_pad)), inner), 256))


def ip_hash(ip: Column) -> Column:
    return F.substring(F.sha2(ip, 256), 1, 16)


def owner_uuid(value: Column, prefix: str = "grocery-user:") -> Column:
    """A valid UUID in lower case as it is; anything else as the UUIDv5 of the
    prefixed text in the URL namespace."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(value, r"^urn:uuid:", ""), r"[{}-]", ""))
    name = F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(F.concat(F.lit(prefix), value), "UTF-8"))
    v5 = let(F.sha1(name), lambda h: F.concat(
        h.substr(1, 12), F.lit("5"), h.substr(14, 3),
        F.substring(F.lit("89ab"), F.conv(h.substr(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1)), h.substr(18, 15),
    ))
    plain = F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(v5)
    return F.regexp_replace(plain, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
