"""Personal data, toxicity, neighbours and the pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from cartwise.llm import neighbours, pii, toxicity
from cartwise.llm.shared import table

RULES = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad_ip = kind == 1 and any(int(p) > 255 for p in m[0].split("."))
            bad_card = kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits))
            if not (bad_ip or bad_card or kind == 3 and not 9 <= len(digits) <= 15):
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_rules():
    pick = random.Random(1)
    parts = ["1", "22", "4785380592391139", ".", ".", "@", "+1", " ", "-", "(", ")", "a", "b.", "com", "%", "\n", "é", "1.2.3.4", "256"]
    for _ in range(4_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans(None) == [] and pii.base_spans("1" * 30_000 + "@" * 500) == []


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_the_model_adds_rewritten_spans_and_keeps_the_rest(tagger):
    found = {t: pii.written(every) for t, (_, every) in zip(TEXTS, pii.all_spans(TEXTS, tagger))}
    assert found[TEXTS[0]] == "email:9:37" and found[TEXTS[1]] == "phone:5:17" and found[TEXTS[2]] == "ip:5:13"
    assert [found[t] for t in TEXTS[3:]] == ["", "", ""]


def test_capitals_of_two_small_characters_shift_nothing(tagger):
    text = "İİİİİİ " + TEXTS[0]
    _, every = next(iter(pii.all_spans([text], tagger)))
    assert pii.written(every) == "email:16:44"


def test_stretches_reach_the_end_of_runs():
    local, domain = "a" * 60, "b" * 70 + ".example"
    text = f"see {local} (at) {domain} and so on" + " and on" * 20 + " " + "z" * 50 + " 7"
    (a, b), *rest = pii.stretches(text)
    assert text[a:b].startswith(local) and domain in text[a:b] and rest
    assert all(x[1] < y[0] for x, y in zip([(a, b), *rest], rest)) and rest[-1][1] == len(text)
    assert pii.stretches("x" * 5_000 + "1" * 5_000) == [(0, 10_000)] and pii.stretches("nothing") == []


TEXTS = ["write to anna.b (at) mail.example.com today", "call 743-555-3824 please", "host 10.2.3.4 is up", "version 3 of 2024-01-02", "nothing here", ""]


def test_gradient_of_the_tagger():
    model, random_ = pii.Tagger(1), np.random.default_rng(2)
    ids, tags = random_.integers(0, pii.SYMBOLS, (3, 7)), random_.integers(0, pii.TAGS, (3, 7))
    _, grad = model.step(ids, tags)
    for name, value in model.p.items():
        at = tuple(random_.integers(0, n) for n in value.shape)
        losses = []
        for step in (1e-5, -2e-5):
            value[at] += step
            losses.append(model.step(ids, tags)[0])
        value[at] += 1e-5
        assert abs((losses[0] - losses[1]) / 2e-5 - grad[name][at]) < 1e-5, name


def test_windows_agree_on_a_long_stretch(tagger):
    text = " ".join(f"{i} 10.0.0.{i}" for i in range(120))
    base, every = next(pii.all_spans([text], tagger))
    assert len(base) == 120 and set(base) <= set(every)


def test_pii_rows(spark, tagger):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a.b@c.de", "x"), (4, "a.b@c.de", "x"), (4, "a.b@c.de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(df, tagger).collect()
    assert len(got) == 5 and sum(r["n_email"] for r in got) == 3
    assert sorted(str(r["text"]) for r in pii.redact(df, tagger).collect()) == ["", "None", "[EMAIL]", "[EMAIL]", "[EMAIL]"]
    assert pii.find(df.limit(0)).collect() == []


def test_kernel_is_that_of_gapped_subsequences():
    def weights(word):
        letters, out = [0, *(ord(c) - 96 for c in word)], {}
        for i in range(len(letters)):
            for j in range(i + 1, len(letters)):
                for k in range(j + 1, min(len(letters), i + toxicity.SPAN)):
                    key = letters[i], letters[j], letters[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    for word in ("loser", "aaaa", "ab", "worthless"):
        row, want = toxicity.features([word])[0].reshape(32, 32, 32), weights(word)
        scale = max(row.max() / max(want.values()), 1e-9) if want else 1
        assert all(abs(row[key] - scale * value) < 1e-5 for key, value in want.items()) and np.count_nonzero(row) == len(want)
    marks = toxicity.features(["loser", "table"])
    close = toxicity.kernel(["loxser", "losers", "garden"], marks)[:, 0]
    assert close[0] > 0.4 and close[1] > 0.7 and close[2] < 0.3


def test_letters_with_signs_between_are_one_word():
    spell = lambda t: toxicity._spell(toxicity.symbols(t)[0])
    assert spell("i-d-i-o-t") == spell("i d i o t") == spell("ÍDIOT") == "`idiot" and spell("a bc") == "`a`bc" and spell("12 !") == ""


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(3)
    sounds = ["ta", "mel", "or", "in", "sto", "ve", "ka", "li", "du", "pe"]
    bad = ["gribnak", "zolfut", "wexham"]
    rows, labels = [], []
    for i in range(600):
        text = [" ".join("".join(pick.choice(sounds) for _ in range(pick.randint(1, 3))) for _ in range(8)) + "." for _ in range(4)]
        toxic = int(i % 4 == 0)
        if toxic:
            word = pick.choice(bad)
            word = pick.choice([word, word + "ka", word[:3] + "x" + word[3:], "-".join(word)])
            text.insert(pick.randrange(5), f"du {word} ve.")
        rows.append((i, " ".join(text), "s"))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(labelled):
    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.93


def test_toxicity_of_real_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    toxic, places = rows["toxic"] == 1, rows["score"].rank()
    area = (places[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area >= 0.95 and rows["predicted"][toxic].mean() >= 0.8 and 1 - rows["predicted"][~toxic].mean() >= 0.97


def test_toxicity_edges(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "é" * 50_000)], "doc_id long, text string")
    got = toxicity.score(odd, toxicity.fit(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert [r["predicted"] for r in none] == [0] * 4
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def brute_nearest(rows, query, k=10):
    own = next(np.array(v) for i, v in rows if i == query)
    found = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v in rows if i != query)
    return [(i, d) for d, i in found[:k]]


def test_nearest_neighbours(spark):
    made = np.random.default_rng(4)
    centres = made.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.4 * made.normal(size=12)).tolist()) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(40)]
    odd = [(900, None), (1000, [0.0] * 12), (1001, [1.0] * 11 + [None]), (1002, [float("nan")] * 12), (1003, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, node int, d int")
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    hits = total = 0
    for query in range(0, 800, 100):
        if query > 739:
            continue
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query)
        want = brute_nearest(rows, query)
        assert [r for r, _, _ in own] == list(range(1, 11))
        hits += len({i for _, i, _ in own} & {i for i, _ in want})
        total += 10
    assert hits / total >= 0.95
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == list(range(700, 710))


@pytest.mark.parametrize("case", ["outlier", "copies"])
def test_neighbours_of_near_rows_are_found(spark, case):
    """One vector 1000 times longer than the rest, or a third of the rows as
    jittered copies of one."""
    made = np.random.default_rng(8)
    x = made.normal(size=(4_800, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if case == "outlier":
        x[4_799] *= 1000
    else:
        x[::3] = x[0] + 1e-4 * made.normal(size=x[::3].shape)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = range(0, 4_799, 96)
    got = neighbours.nearest(df, df.filter("vec_id % 96 = 0 AND vec_id < 4799"), pool=40).collect()
    want = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in asked}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) / (10 * len(asked)) >= 0.9


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [4.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, df.filter("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark, labelled, tmp_path):
    docs, labels = labelled
    shape = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) + 0L n_chars")
    extra = spark.createDataFrame([(5000, None, "en", "s", 0), (5001, "mail a.b@c.de now and then and so on ok", "en", "s", 1), (5002, "mail a.b@c.de now and then and so on ok", "en", "s", 1), (None, "x", "en", "s", 1)], shape.schema)
    shape.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("quality", labels["toxic"]).write.parquet(str(tmp_path / "labels.parquet"))
    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    assert len(clean & kept["toxicity"].keys()) >= 0.97 * len(clean) and {5000, 5001, 5002, None} <= kept["toxicity"].keys()
    assert 5001 in kept["near_duplicates"] and 5002 not in kept["near_duplicates"] and None in kept["near_duplicates"]
    assert kept["personal_data"][5001].startswith("mail [EMAIL] now") and kept["personal_data"][5000] is None
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == kept["personal_data"].keys()
