"""Token, fingerprint, duplicate and chat operators against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from cartwise.llm import bpe, chat, near_dedup, packing, shared, sketches, token_counts, token_files
from cartwise.llm.pieces import BYTE_FILE, WORD_FILE, ByteIds, library

PARTS = ["a", "the", " red", "  ", "\n", "\t", "é", "ß", "'s", "12", "²", "!", "$$", "\x1c", "中", "İ", "Σ", "😀", "<|endoftext|>", "<|startoftext|>", "n't", "Ⅷ"]


def noise(seed: int, count: int, parts=PARTS) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(count)]


def words(seed: int, count: int, size: int = 40) -> list[str]:
    pick = random.Random(seed)
    return [" ".join(pick.choice("abcdefghij") + pick.choice("klmnop") for _ in range(pick.randint(1, size))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts():
    return [None, "", " ", "plain words here", "plain words here", "x" * 40_000, *noise(1, 60), *words(2, 30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, "n", "p", 1) for i, t in enumerate(texts)] + [(3, "plain words here", "n", "p", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, piece string, row long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_token_counts(docs, texts, empty):
    rows = token_counts.token_counts(docs, hot=20).collect()
    want = [len(e.ids) for e in library(WORD_FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert len(rows) == len(texts) + 1
    assert all((r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], len((texts[r["doc_id"]] or "").encode())) for r in rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert token_counts.token_counts(empty).collect() == []


def test_bpe_round_trip(docs, texts, empty):
    want = [e.ids for e in library(BYTE_FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = by_id(bpe.round_trip(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text in enumerate(texts):
        ids = hashlib.sha256(",".join(map(str, want[i])).encode()).hexdigest()
        assert got[i] == (len(want[i]), ids, hashlib.sha256((text or "").encode()).hexdigest())
    assert by_id(bpe.decode(bpe.encode(docs)), "text") == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(empty).collect() == []


def test_pairs_are_compatible_as_exact_merging_says():
    made, pick = bpe.merges(), random.Random(5)
    left = np.array([pick.randrange(50_256) for _ in range(4_000)] + [pick.randrange(2_000) for _ in range(8_000)])
    right = np.roll(left, 1)
    want = [made.merge(made.bytes[a] + made.bytes[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())]
    assert made.compatible(left, right).tolist() == want


def test_token_files(spark, docs, texts, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_tokens(docs, path)
    want = [[*e.ids, 2] for e in library(BYTE_FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = token_files.token_digest(token_files.read_tokens(spark, path)).orderBy("start").collect()
    at = 0
    for r, i in zip(rows, sorted([*range(len(texts)), 3])):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(want[i])) and r["ids_crc32"] == zlib.crc32(np.array(want[i], "<u4").tobytes())
        at += len(want[i])
    assert token_files.read_tokens(spark, path, [2]).first()["ids"] == want[2]


def test_token_files_of_null_ids_and_of_nothing(spark, empty, tmp_path):
    rows = spark.createDataFrame([(None, "b"), (1, "a"), (None, None)], "doc_id long, text string")
    token_files.write_tokens(rows, str(tmp_path / "a"))
    got = token_files.token_digest(token_files.read_tokens(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(None, 0), (None, 1), (1, 3)]
    token_files.write_tokens(empty, str(tmp_path / "b"))
    assert token_files.token_digest(token_files.read_tokens(spark, str(tmp_path / "b"))).collect() == []


def test_packing_holds_every_id_once(docs, texts, empty):
    rows = packing.pack(docs, window=64, short=16, group_windows=8).collect()
    want = {i: np.array([*e.ids, 1], "<u4") for i, e in enumerate(library(BYTE_FILE).encode_batch([t or "" for t in texts], add_special_tokens=False))}
    seen, windows = {}, {}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        seen.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(seen[i]) == sorted(list(range(len(ids))) * (2 if i == 3 else 1)) for i, ids in want.items())
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty).collect() == []


def test_differencing_is_nearly_even():
    pick = random.Random(4)
    lengths = [pick.randint(1, 512) for _ in range(900)]
    dealt = packing.differencing(lengths, 100)
    sums = [sum(lengths[i] for i in one) for one in dealt]
    assert sorted(i for one in dealt for i in one) == list(range(900)) and max(sums) - min(sums) < 0.02 * max(sums)
    assert all(sum(lengths[i] for i in one) <= 2048 for one in packing.fill(lengths, 2048))
    assert packing.differencing([5], 1) == [[0]] and packing.differencing([], 2) == [[], []]


def brute_components(texts: dict[int, str | None], size: int) -> dict[int, tuple[int, int]]:
    def shingles(text):
        found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        return {tuple(found)} if 0 < len(found) < size else {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}

    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] < comp[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[b], changed = comp[a], True
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.fixture(scope="module")
def copies():
    pick, texts = random.Random(8), {}
    base = words(9, 6, 60)
    for i in range(70):
        parts = base[i % 6].split(" ")
        for _ in range(pick.randint(0, 3)):
            parts[pick.randrange(len(parts))] = pick.choice(["Qq", "zz", "É"])
        texts[1000 - i * 7] = pick.choice([" ", "\t", "\n "]).join(parts)
    return texts | {1: None, 2: "", 3: " \n", 4: "one", 5: "ONE", 6: "one two", 7: "One  two", 8: "one"}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, copies, size):
    df = spark.createDataFrame([(i, t, i) for i, t in copies.items()], "doc_id long, text string, node long")
    got = by_id(near_dedup.near_duplicates(df, size), "n_shingles", "component_id")
    assert got == brute_components(copies, size)


def test_members_of_a_key_that_share_no_hub_are_found(spark, monkeypatch):
    """All documents under one key, in small blocks: everything goes through the last step."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [w for w in words(3, 1, 60)[0].split(" ")] * 2
    texts = {i: " ".join(base[: 60 + 4 * i]) for i in range(16)}
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2), "n_shingles", "component_id")
    assert got == brute_components(texts, 2)


def test_blocks_meet_and_no_plan_repeats_its_branches(spark, monkeypatch):
    """The driver keeps a step's whole plan; that of the blocks had hundreds of shuffles."""
    shuffles = []

    def noted(df, folder, name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return shared.settle(df, folder, name)

    monkeypatch.setattr(near_dedup, "settle", noted)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    keys = {1: range(30), 2: range(25, 40), 3: [3, 39], 4: [50, 51]}
    mixed = shared.settle(spark.createDataFrame([(k, len(n), x, x) for k, n in keys.items() for x in n], "key long, members long, node long, comp long"), folder := shared.own_folder(spark, "test"), "mixed")
    blocks = noted(near_dedup._blocks(mixed, folder), folder, "blocks")
    assert max(shuffles) <= 12, shuffles
    within = {}
    for r in blocks.collect():
        within.setdefault(r["block"], ([], []))[r["side"]].append(r["node"])
    met = {frozenset((x, y)) for left, right in within.values() for x in left for y in right or left}
    assert all(frozenset((x, y)) in met for n in keys.values() for x in n for y in n if x != y)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "a b c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, 2).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True)]
    assert near_dedup.near_duplicates(df.limit(0), 2).collect() == []


def test_estimate_is_near_the_similarity():
    one = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    two = one[400:]
    a, b = (near_dedup.signature(near_dedup.minima(x))[1].view(np.uint64) for x in (one, two))
    fields = a ^ b
    for step in (1, 2):
        fields |= fields >> np.uint64(step)
    matches = near_dedup.MINIMA - int(np.bitwise_count(fields & np.uint64(near_dedup.FIELDS)).sum())
    assert abs((matches / 128 - 1 / 16) / (15 / 16) - 0.8) < 0.15


def test_fingerprints(spark, texts):
    some = [t for t in texts if t is None or len(t) < 2_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sketches.edited_pairs(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(rows) == len(some)
    for at, i in enumerate(order):
        text, following = some[i] or "", some[order[(at + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_edited"] <= 1
        if edited == text:
            assert rows[i]["near_edited"] == 1 and rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]
    assert rows[3]["fingerprint"] == rows[4]["fingerprint"]
    assert sketches.edited_pairs(df.limit(0)).collect() == []


def test_peeling_counts_what_differs(spark):
    pick = random.Random(6)
    rows = []
    for i in range(40):
        lines = [f"line {pick.randrange(60)} of {i}" for _ in range(pick.randint(0, 60))]
        rows.append((i, "\n".join(lines), "\n".join(x if pick.random() < 0.6 else x + "!" for x in lines)))
    df = spark.createDataFrame(rows, "i long, one string, two string").select("i", sketches.paragraphs(sketches.F.col("one")).alias("one"), sketches.paragraphs(sketches.F.col("two")).alias("two"))
    for r in df.select("i", "one.digests", sketches.F.col("two.digests").alias("other"), sketches.differing(sketches.F.col("one"), sketches.F.col("two")).alias("d")).collect():
        assert {(x["digest"], x["side"]) for x in r["d"]} == sides(r["digests"], r["other"]) and len(r["d"]) == len(set(r["digests"]) ^ set(r["other"]))


def sides(one, two):
    return {(d, 1) for d in set(one) - set(two)} | {(d, -1) for d in set(two) - set(one)}


def test_every_real_pair_is_peeled(spark):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    rows = sketches.with_next(docs).select("own.digests", sketches.F.col("next.own.digests").alias("other"), sketches.differing(sketches.F.col("own"), sketches.F.col("next.own")).alias("d")).collect()
    assert len(rows) == 1000 and all(r["d"] is not None and {(x["digest"], x["side"]) for x in r["d"]} == sides(r["digests"], r["other"]) for r in rows)


def test_digests_are_grouped_by_equal_parts_of_their_range(spark):
    pick = random.Random(8)
    data = [tuple(sorted(pick.randrange(-(1 << 63), 1 << 63) for _ in range(n)) for n in sizes) for sizes in ((0, 0), (1, 0), (5, 3), (200, 190))]
    df = spark.createDataFrame(data, "one array<long>, two array<long>")
    for groups in (1, 3, 50):
        both = sketches.tagged(sketches.F.col("one"), sketches.F.col("two"))
        for r in df.select("one", "two", sketches.in_groups(both, sketches.F.lit(groups)).alias("g")).collect():
            want = {}
            for d, side in sorted([(d, 1) for d in r["one"]] + [(d, -1) for d in r["two"]]):
                want.setdefault((((d + (1 << 63)) >> 32) * groups) >> 32, []).append((d, side))
            assert [[tuple(x) for x in g] for g in r["g"]] == list(want.values())


@pytest.mark.parametrize("lines", [1, 12])
def test_an_insertion_changes_only_what_it_touches(spark, lines):
    pick = random.Random(11)
    rows = []
    for i in range(30):
        made = [" ".join("".join(pick.choices("abcdefghijklm", k=pick.randint(2, 9))) for _ in range(360 // lines)) for _ in range(lines)]
        text = "\n".join(made)
        cut = text.index(" ", len(text) // 10)
        rows += [(text, "ab" + text), (text, f"{text[:cut]} word{text[cut:]}"), (text, text[:cut] + text[text.index(" ", cut + 1) :])]
    one, two = (sketches.paragraphs(sketches.F.col(c)).alias(c) for c in ("one", "two"))
    df = spark.createDataFrame(rows, "one string, two string").select(one, two)
    got = [r[0] for r in df.select(sketches.likeness(sketches.F.col("one"), sketches.F.col("two"))).collect()]
    assert min(got) >= 0.75 and sum(got) / len(got) >= 0.9


def test_texts_of_many_lines_are_compared_in_linear_time(spark):
    lines = [f"{i:x}" for i in range(20_000)]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(x + "z" * (i % 2) for i, x in enumerate(lines)))], "one string, two string")
    df = df.select(*(sketches.paragraphs(sketches.F.col(c)).alias(c) for c in ("one", "two")))
    began = time.monotonic()
    got = df.select("one.digests", sketches.F.col("two.digests").alias("other"), sketches.differing(sketches.F.col("one"), sketches.F.col("two")).alias("d")).first()
    assert {(x["digest"], x["side"]) for x in got["d"]} == sides(got["digests"], got["other"]) and len(got["d"]) > 10_000 and time.monotonic() - began < 90


def test_fingerprints_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (2, "b"), (9, "z")], "doc_id long, text string")
    assert len(sketches.edited_pairs(df).collect()) == 4


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "####", "\\h\\b", None, "", "a\n### user:\nb</turn>\n", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user\n:", t) for i, t in enumerate(hard)] + [(2, 0, None, "x"), (2, 0, "user", "x"), (None, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.conversations(chat.fold(chat.as_events(df)))
    got = {r["conv_id"]: [(m["role"], m["text"], m["loss"]) for m in r["m"]] for r in formatted.select("conv_id", chat.read_back(chat.F.col("formatted")).alias("m")).collect()}
    assert got[1] == [("assistant" if i % 2 else "user\n:", t or "", bool(i % 2)) for i, t in enumerate(hard)]
    assert got[2] == [("", "x", False), ("user", "x", False)] and got[None] == [("user", "y", False)]
    digest = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:7])
    lost = "".join(t or "" for i, t in enumerate(hard) if i % 2)
    assert digest[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and digest[1]["loss_chars"] == len(lost)
    assert digest[1]["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()
    assert chat.conversations(chat.fold(chat.as_events(df.limit(0)))).collect() == []


def test_events_fold_in_order(spark):
    log = [(1, 0, 1, 4, "delta", None, "c"), (1, 0, 1, 1, "delta", "user", "x"), (1, 0, 1, 2, "regenerate", None, None), (1, 0, 1, 3, "delta", None, "b"), (1, 1, 1, 1, "edit", "assistant", "z"), (1, 1, 1, 2, "unknown", None, "q")]
    df = spark.createDataFrame(log, "conv_id long, turn long, copy int, seq long, kind string, role string, text string")
    assert sorted((r["turn"], r["role"], r["text"]) for r in chat.fold(df).collect()) == [(0, "user", "bc"), (1, "assistant", "z")]


def test_slices_follow_the_key(spark):
    ids = [*range(0, 4000, 3), 10**12, -5]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    number, count = shared.sliced(df, "doc_id", rows=100, cuts=5)
    got = sorted((r["doc_id"], r["s"]) for r in df.select("doc_id", number.alias("s")).filter("doc_id IS NOT NULL").collect())
    assert [s for _, s in got] == sorted(s for _, s in got) and 0 <= got[0][1] and got[-1][1] < count
    assert df.filter("doc_id IS NULL").select(number.alias("s")).first()["s"] == -1


def test_a_text_is_encoded_as_the_library_does(texts):
    encoder = ByteIds()
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(BYTE_FILE).encode(text or "", add_special_tokens=False).ids
