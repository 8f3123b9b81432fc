"""Micro-fixtures of the column functions."""

from __future__ import annotations

import hashlib
import hmac
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from words import best_extent

from cartwise.functions import codes, geo, money, names, similarity, sizes, traits, vocab
from cartwise.operators import textsearch as X


@pytest.mark.parametrize(
    "name, status, qty, unit, pack",
    [
        ("Gouda juust kg", "SKIP_KG_PRICED", None, None, None),
        ("Tomat 2 kg", "WOULD_SET_SINGLE", 2000, "g", 1),
        ("X 10 X 12 5 G", "WOULD_SET_MULTIPACK_RECOVERED_DECIMAL", 12.5, "g", 10),
        ("Jogurt 4x120g", "WOULD_SET_MULTIPACK", 120, "g", 4),
        ("Piim 1,5 L", "WOULD_SET_SINGLE", 1500, "ml", 1),
        ("Y 5 g", "SKIP_AMBIGUOUS_SMALL_QTY", None, None, None),
        ("Kohv 10 g", "WOULD_SET_SINGLE", 10, "g", 1),
        ("", "SKIP_UNPARSEABLE", None, None, None),
        ("Sai", "SKIP_UNPARSEABLE", None, None, None),
    ],
)
def test_parse_quantity(one, name, status, qty, unit, pack):
    got = one(sizes.parse_quantity(F.lit(name)))
    assert got["status"] == status
    assert got["net_qty"] == (None if qty is None else Decimal(str(qty)))
    assert (got["net_unit"], got["pack_count"]) == (unit, pack)


def test_parse_size_text(one):
    got = one(sizes.parse_size_text(F.lit("6 x 0,33 l")))
    assert (got["pack_count"], got["net_qty"], got["net_unit"], got["pack_pattern"]) == (6, Decimal("330"), "ml", "6 x 0,33 l")
    got = one(sizes.parse_size_text(F.lit("500 g")))
    assert (got["pack_count"], got["net_qty"], got["net_unit"], got["pack_pattern"]) == (1, Decimal("500"), "g", None)
    assert one(sizes.parse_size_text(F.lit("abc"))) is None


@pytest.mark.parametrize("text, price", [("3€49", "3.49"), ("1 99", "1.99"), ("3,5", "3.50"), ("25%", None), ("349", "3.49"), ("49", None), ("1 234€5", "1234.50")])
def test_card_price(one, text, price):
    assert one(money.parse_price_text(F.lit(text))) == (None if price is None else Decimal(price))


def test_ean_variants(one):
    assert one(codes.normalize_ean(F.lit("400638133393"), "staging")) == "0400638133393"
    assert one(codes.normalize_ean(F.lit("04006381333931"), "staging")) == "4006381333931"
    assert one(codes.normalize_ean(F.lit("-"), "staging")) is None
    assert one(codes.normalize_ean(F.lit("14006381333931"), "staging")) == "14006381333931"
    assert one(codes.normalize_ean(F.lit("14006381333931"), "logistic")) == "4006381333931"
    assert one(codes.normalize_ean(F.lit("14006381333931"), "checked")) == "4006381333931"
    assert one(codes.normalize_ean(F.lit("14006381333930"), "checked")) == "14006381333930"
    assert one(codes.is_valid_ean13(F.lit("4006381333931")))
    assert not one(codes.is_valid_ean13(F.lit("4006381333930")))
    assert one(codes.is_bad_ean(F.lit("11111111"))) and one(codes.is_bad_ean(F.lit("123")))
    assert not one(codes.is_bad_ean(F.lit("4006381333931")))


def test_names(one):
    assert one(names.canonical_name(F.lit("Coop Tomat 1 kl., kg"))) == "tomat"
    assert one(names.canonical_name(F.lit("Rimi Tomat kg"))) == "tomat"
    assert one(names.produce_family(F.lit("Tšillipaprika"))) == "chili"
    assert one(names.produce_family(F.lit("Kirsstomat"))) == "tomato"
    assert one(names.produce_family(F.lit("Tomat ja kurk"))) is None
    assert one(names.clean_brand(F.lit("Tootja: Määramata"))) == "Määramata"
    assert one(names.clean_brand(F.lit("lisa ostukorvi"))) == ""
    assert one(names.repair_encoding(F.lit("Oun ja Olu hea"))) == "Õun ja Õlu hea"
    assert one(names.repair_encoding(F.lit("Rostov oun"))) == "Rostov oun"
    assert one(names.translate_measure(F.lit("2 tbsp chopped"))) == "2 spl hakitud"
    assert one(names.translate_ingredient(F.lit("Fresh Chicken"))) == "kana"
    assert one(names.slug(F.lit("Õun & Šokk!"))) == "oun-sokk"


def test_pseudonyms(one):
    for text in ("abc", "õ" * 100, "x" * 64):
        expected = hmac.new(b"secret", text.encode(), hashlib.sha256).hexdigest()
        assert one(codes.device_key(F.lit(f"  {text} "), "secret")) == expected
    long_key = "k" * 90
    assert one(codes.device_key(F.lit("a"), long_key)) == hmac.new(long_key.encode(), b"a", hashlib.sha256).hexdigest()
    assert one(codes.device_key(F.lit("  "), "secret")) is None
    assert one(codes.device_key(F.lit("a"), "")) is None
    for value in ("1", "77", "õ", str(uuid.uuid4()).upper()):
        try:
            expected = str(uuid.UUID(value))
        except ValueError:
            expected = str(uuid.uuid5(uuid.NAMESPACE_URL, f"grocery-user:{value}"))
        assert one(codes.owner_uuid(F.lit(value))) == expected


def test_word_similarity_is_the_best_run(spark):
    rng = random.Random(5)
    words = ["tomat", "kirss", "tomati", "piim", "pii", "õun", "kg", "-", "a_b", ""]
    pairs = [tuple(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in "ab") for _ in range(200)] + [("", "piim"), ("piim", ""), (None, "x"), ("x", None)]
    rows = spark.createDataFrame(pairs, "q string, t string").withColumn("s", similarity.word_similarity(F.col("q"), F.col("t"))).collect()
    for r in rows:
        assert r["s"] == pytest.approx(best_extent(r["q"], r["t"]))


def test_similar_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    words = ["tomat", "kirss", "tomati", "piim", "piimasai", "õun", "kurk", "kirsstomat", "sai"]
    left, right = ([(rng.randint(0, 2), " ".join(rng.choices(words, k=rng.randint(1, n)))) for _ in range(60)] for n in (2, 4))
    for least in (0.3, 0.6, 1.0):
        got = X.similar_pairs(spark.createDataFrame(left, "k int, wanted string"), spark.createDataFrame(right, "k int, shown string"), "k", least).collect()
        want = {(k, q, t) for k, q in left for j, t in right if j == k and best_extent(q, t) >= least - 1e-12}
        assert {tuple(r)[:3] for r in got} == want and len(got) == len(want)
        assert all(r["similarity"] == pytest.approx(best_extent(r["wanted"], r["shown"])) for r in got)


def test_words_are_found_anywhere_inside(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcõ ", k=rng.randint(0, 12))) for _ in range(150)]
    words = [*("".join(rng.choices("abcõ", k=rng.randint(1, 5))) for _ in range(60)), "", "zzz", "abx"]
    for sizes in ((1, 2, 3), (2, 3)):
        got = X.find_inside(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in texts], "text string"), sizes)
        want = {(w, t) for w in words for t in texts if len(w) >= sizes[0] and w in t}
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_traits(one):
    sub = F.lit("dairy_milk")
    value = lambda text: one(traits.hard_values(sub, F.lit(text)))[:2]
    assert value("Piim 2,5%") == ["plain", "pct_2.5"]
    assert value("Talupiim 3,6-4,2%") == ["plain", "pct_4.0"]
    assert value("Cappuccino piim") == ["flavored", None]
    assert one(traits.downgrade_tags(F.lit("tea"), F.lit("metsmaasika tee"))) == ["flavour_variant:wild_strawberry"]
    assert one(traits.downgrade_tags(F.lit("tea"), F.lit("maasika tee"))) == ["flavour_variant:strawberry"]
    assert one(traits.downgrade_tags(F.lit("oils_olive"), F.lit("ekstra väärisoliiviõli"))) == one(traits.downgrade_tags(F.lit("oils_olive"), F.lit("ekstra neitsioliiviõli")))
    animal = list(traits.HARD).index("animal_type")
    assert one(traits.hard_values(F.lit("meat_minced"), F.lit("sea-veise hakkliha")))[animal] == "mixed"
    assert one(traits.hard_values(F.lit("meat_minced"), F.lit("kalkunihakkliha")))[animal] == "turkey"


def test_every_rule_pattern_agrees_with_python(spark):
    """The same patterns, run by Spark and by Python's re."""
    import re

    texts = ["metsmaasika jogurt", "maasika-banaani", "õuna mahl", "Ürdi juust", "küüslaugu", "härjaliha", "5-vilja leib", "täistera", "12 kuud", "in-cup", "väärisoliiviõli ekstra neitsi", "sõstra punase sõstra", "qualità oro", "mustsõstra"]
    tables = {"profile": vocab.FLAVOUR_PROFILE, "variant": vocab.FLAVOUR_VARIANT, "cheese": vocab.CHEESE_MODIFIER, "grain": vocab.GRAIN_TYPE, "coffee": vocab.COFFEE_PRODUCT_LINE, "oil": vocab.OIL_GRADE}
    df = spark.createDataFrame([(t.lower(),) for t in texts], "t string")
    for name, table in tables.items():
        got = df.select("t", *[names.matches_any(F.col("t"), p).alias(k) for k, p in table.items()]).collect()
        for row in got:
            for key, patterns in table.items():
                assert row[key] == any(re.search(p, row["t"]) for p in patterns), (name, key, row["t"])


def test_haversine_and_links(one):
    assert one(geo.haversine_km(F.lit(59.437), F.lit(24.7536), F.lit(58.378), F.lit(26.729))) == pytest.approx(163.4, abs=0.5)
    assert tuple(one(geo.coords_from_url(F.lit("https://maps/?destination=59.4%2C24.7")))) == (59.4, 24.7, None)
    assert one(geo.coords_from_url(F.lit("https://maps/?q=Veski+tn+3")))["query"] == "Veski tn 3"
