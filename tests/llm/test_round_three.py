"""Repeated passages, ranked search and whitening, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.llm import lexical, suffixes, whitening

CLASHING = "doc_id long, text string, anchor long, tie long, marks string, copy int, kind int, term string, item_id long, score long"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "m", 3, 4, "t", 5, 6) for r in rows], CLASHING)


# ---- repeated passages ---------------------------------------------------------


def brute(spark, rows):
    """Result rows, from a table of all strings of LENGTH bytes seen so far."""
    hashes = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for t in {t or "" for _, t in rows}}
    many = len({i for i, _ in rows}) < len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1] or ""] if many else 0))
    seen, out = set(), []
    for i, text in order:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        strings = [data[a : a + suffixes.LENGTH] for a in range(len(data) - suffixes.LENGTH + 1)]
        for a, s in enumerate(strings):
            if s in seen:
                gone[a : a + suffixes.LENGTH] = True
            seen.add(s)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def word_texts(seed, n, repeated=False):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdeéß漢") for _ in range(pick.randint(1, 8))) for _ in range(60)]
    say = lambda k: " ".join(pick.choice(words) for _ in range(k))
    shared = [say(pick.randint(15, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(pick.randint(0, 30)), pick.choice(shared), say(pick.randint(0, 30)), pick.choice([*shared, ""]), say(3)]
        rows.append((i * 3 % (n // 2) if repeated else i * 7 % 101, " ".join(parts)))
    return rows


ODD = [(500, None), (501, ""), (502, "short"), (503, "a" * 450), (504, "a" * 99), (505, "ab" * 200), (506, "\x00" * 120 + "x"), (507, "a" * 130 + "b"), (None, "q" * 150)]


@pytest.mark.parametrize("chunk", [2_000, 3])
def test_repeats_are_those_of_brute_force(spark, chunk):
    rows = word_texts(1, 60) + ODD
    got = suffixes.remove_repeats(clashing(spark, rows), chunk).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(spark, rows)


def test_repeats_among_repeated_rows_and_ids(spark):
    rows = word_texts(2, 30, repeated=True) + ODD + ODD + [(None, "z" * 220), (None, None)]
    got = suffixes.remove_repeats(clashing(spark, rows), 5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(spark, rows)


def test_no_rows_without_documents(spark):
    assert suffixes.remove_repeats(clashing(spark, [])).collect() == []
    assert [tuple(r)[1:4] for r in suffixes.remove_repeats(clashing(spark, [(1, None)])).collect()] == [(0, 0, 0)]


def test_two_stage_order_is_the_order_of_suffixes():
    random_ = np.random.default_rng(0)
    for _ in range(200):
        data = random_.integers(0, random_.integers(1, 5), random_.integers(1, 300)).astype(np.uint8)
        whole = data.tobytes()
        assert suffixes.suffix_order(data, 400).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
    assert len(suffixes.suffix_order(np.empty(0, np.uint8))) == 0


def test_contexts_hold_every_string_once_also_in_pieces():
    text = " ".join(random.Random(3).choice(["alpha", "beta", "gamma", "δ"]) for _ in range(4_000)).encode()
    strings = {}
    for piece in (1 << 20, 700):
        for found in suffixes.contexts([b"x" * 30, text, text[50:]], piece):
            for which, start, size, anchor, _ in zip(*(x.tolist() for x in found)):
                for at in range(start, start + size):
                    strings.setdefault((piece, which), []).append((at, anchor))
    for piece in (1 << 20, 700):
        assert [a for a, _ in sorted(strings[piece, 1])] == list(range(len(text) - suffixes.LENGTH + 1))
        assert [x for _, x in sorted(strings[piece, 1])][50:] == [x for _, x in sorted(strings[piece, 2])]  # anchors follow the content
    assert strings[1 << 20, 1] == strings[700, 1]


# ---- ranked search -------------------------------------------------------------


def brute_search(docs, items, k):
    term = re.compile(lexical.TERM)
    small = str.maketrans(lexical.UPPER, lexical.LOWER)
    words = [(i, Counter(term.findall((t or "").translate(small)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, length = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term.findall((t or "").translate(small)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in words:
            m = 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_search_is_that_of_brute_force(spark):
    pick = random.Random(4)
    words = ["".join(pick.choice("abcXYZ09é漢") for _ in range(pick.randint(1, 4))) for _ in range(300)]
    say = lambda k: pick.choice([" ", "-", "\n", "!? "]).join(pick.choice(words) for _ in range(k))
    docs = [(i, say(pick.randint(1, 60))) for i in range(700)] + [(900, None), (901, ""), (902, "!!! "), (903, say(9_000)), (None, "abc Xyz"), (None, "abc Xyz")]
    docs += docs[:40] + [(1000 + i, "Tie tie") for i in range(90)]
    items = [(i, say(pick.randint(1, 25))) for i in range(25)] + [(30, None), (31, ""), (32, "tie"), (33, "tie"), (33, "abc"), (None, "xyz abc"), (34, "nowhere")]
    got = lexical.search(clashing(spark, docs).repartition(5), spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, doc_id long, rank int"), 50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, 50)
    assert lexical.search(clashing(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert lexical.search(clashing(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_bounds_are_never_below_scores():
    pick = random.Random(5)
    words = [str(i).encode() for i in range(40_000)]
    asked = lexical.Asked([{"item_id": i, "term": pick.choice(words).decode()} for i in range(20) for _ in range(30)])
    asked.weigh(100, 50_000, {i: pick.randint(0, 100) for i in asked.vocabulary.values()})
    best = lexical.Best(asked, 3)
    group = [lexical.Document(i, pick.choices(words, k=pick.randint(1, 20_000)), 100, 50_000) for i in range(12)]
    bounds = best.bounds(group)
    for row, document in enumerate(group):
        for item, terms in enumerate(asked.terms):
            assert bounds[row, item] >= document.exact(terms, asked.weights)


# ---- whitening -----------------------------------------------------------------


def check_whitening(got, rows, weights, components=4):
    x = np.array([np.floor(256 * np.array(v, float)) for _, v in rows]).astype(np.int64)
    distinct, times = np.unique(x, axis=0, return_counts=True)
    w = times if weights == "count" else np.ones(len(times), np.int64)
    n, sums = int(w.sum()), (w[:, None] * distinct).sum(axis=0)
    centred = distinct - sums / n
    v = (centred * w[:, None]).T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1][:components]
    per = {}
    for r in got:
        per.setdefault(r["component"], []).append(r)
    assert sorted(per) == list(range(1, min(components, x.shape[1]) + 1))
    by_row = Counter((i, int((n * np.array(v) - sums) @ (n * np.array(v) - sums))) for (i, _), v in zip(rows, x))
    for k, found in per.items():
        assert Counter((r["vec_id"], r["deviation"]) for r in found) == by_row
        assert all(r["n"] == n and r["identity_error"] <= 1e-9 and abs(r["explained"] - values[k - 1] / np.trace(v)) < 1e-9 for r in found)
    return v, values, sums / n


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_of_copies_and_faulty_rows(spark, weights):
    random_ = np.random.default_rng(6)
    vectors = random_.normal(size=(150, 6)) * [5, 4, 3, 2, 1, 0.5]
    rows = [(i, vectors[i % 150 if i < 200 else 7].tolist()) for i in range(320)] + [(None, [0.0] * 6), (5, vectors[5].tolist()), (5, vectors[5].tolist())]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + bad], "vec_id long, embedding array<double>, x int, times int, component int")
    got = whitening.whiten(df, weights=weights).collect()
    v, values, mean = check_whitening(got, rows, weights)
    table = {}
    for r in got:
        table.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    ids = [i for i in range(320) if i != 5]
    z = np.array([[table[i][k] for k in range(1, 5)] for i in ids])
    x = np.floor(256 * np.array([rows[i][1] for i in ids]))
    own = np.linalg.eigh(v)[1][:, ::-1][:, :4]
    assert np.allclose(np.abs(z), np.abs((x - mean) @ own / np.sqrt(values)), atol=1e-9)


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got) == [
        (1, 1, 1, 0, None, None), (1, 2, 1, 0, None, None), (2, 1, 1, 0, None, None), (2, 2, 1, 0, None, None)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(5)], schema)).collect()
    assert all(r["whitened"] is None for r in line if r["component"] == 2) and {round(r["explained"], 12) for r in line} == {1.0, 0.0}


def test_large_grid_values_are_exact(spark):
    rows = [(i, [float(i * 2**20 + 1), -1.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[256 * (i * 2**20 + 1), -256] for i in range(40)]
    s = sum(v[0] for v in x)
    right = {i: (40 * v[0] - s) ** 2 for i, v in enumerate(x)}
    assert all(r["deviation"] == (right[r["vec_id"]] if right[r["vec_id"]] < 2**63 else None) for r in got)
