"""Toxicity by a string-kernel support vector machine.

Words are compared by the subsequences of three letters that they share, gaps
allowed: a subsequence that spans s letters weighs DECAY ** s, up to a span of
SPAN. The start of a word counts as a letter; digits and signs within a word
are passed over, and letters that stand alone are joined, so that "i-d-i-o-t",
"i d i o t" and "idxiot" stay close to "idiot". The kernel is mapped to a few
hundred dimensions by Nystroem landmarks, and a squared-hinge machine is
trained there. As the kernel is a product of subsequence weights, landmarks and
machine fold into one table of 32**3 weights, and a text is scored by look-ups.

Labels belong to documents: a sentence has the label of its document, and which
of its words are to blame isn't known. So every word takes part on both sides,
with the share of toxic and of clean documents that hold it. Words of both
kinds alike then get about 0, and only such that toxic documents prefer get far
above; what single words are too rare to tell, words with common subsequences
tell together. Landmarks are words whose preference is the most significant,
and others by hash. Some words of the first kind also enter with one letter put
in.

A document's evidence is what its words have above LEAST, added up and divided
by a power of their number, as a long text has more words that are high by
chance. Its curve to a likelihood is fitted on documents that the machine
behind it didn't see: each of FOLDS machines is trained without a part of the
rows, and scores that part.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.common import let
from cartwise.llm.registry import query
from cartwise.llm.shared import own_folder, settle, table

LETTERS = 32
DECAY, SPAN = 0.7, 5
#: (distance of the second and of the third letter from the first)
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Bounds of what the machine is fitted on: labelled rows, and their words: those
#: that toxic documents prefer most significantly, and the most frequent others.
MAX_ROWS, MAX_PREFERRED, MAX_OTHERS, LANDMARKS = 10_000, 3_000, 5_000, 320
#: Preferred words that enter with a letter put in, and their weight.
INSERTED, INSERTED_WEIGHT = 200, 0.1
PENALTY = 1e-4
FOLDS = 5
#: Score from which a word is evidence, and the power of the number of words.
LEAST, POWER = 0.45, 0.75

_ENDS = np.array([ord(c) for c in ".!?\n"], np.uint32)


def _letter_table() -> np.ndarray:
    """Class of each character below 0x250: 1..26 for letters without their
    marks, 27 for other letters, 0 for white space, -1 for what is passed over."""
    found = np.full(0x250, -1, np.int8)
    for code in range(0x250):
        char = chr(code)
        if char.isspace():
            found[code] = 0
        elif char.isalpha():
            base = unicodedata.normalize("NFD", char.lower())[0]
            base = {"ß": "s", "æ": "a", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "œ": "o"}.get(base, base)
            found[code] = ord(base) - 96 if "a" <= base <= "z" else 27
    return found


_TABLE = _letter_table()


def symbols(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, a 0 before each, where these zeros are, and the
    number of the sentence that each word starts in."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _TABLE[np.minimum(codes, 0x24F)].astype(np.int8)
    if len(codes) and codes.max() >= 0x250:
        far = codes >= 0x250
        kinds[far] = 28 + (codes[far] % 3).astype(np.int8)
        kinds[far & (codes >= 0x2000) & (codes < 0x2C00)] = -1
        kinds[(codes == 0x3000) | (codes >= 0x2000) & (codes <= 0x200A) | (codes == 0x2028) | (codes == 0x2029)] = 0
    at = np.flatnonzero(kinds > 0)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.cumsum(kinds == 0)[at]
    new = np.ones(len(at), bool)
    np.not_equal(gaps[1:], gaps[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    alone = np.diff(np.append(starts, len(at))) == 1
    new[starts[1:][alone[1:] & alone[:-1]]] = False  # letters that stand alone, one after the other
    places = np.arange(len(at)) + np.cumsum(new)
    out = np.zeros(len(at) + int(new.sum()), np.int64)
    out[places] = kinds[at]
    sentences = np.cumsum(np.isin(codes, _ENDS))[at[new]]
    return out, places[new] - 1, sentences


def _triples(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of gaps: places of the first letter, numbers of the
    subsequences there, and their weight."""
    word = np.cumsum(letters == 0)
    for second, third in GAPS:
        size = len(letters) - third
        if size <= 0:
            continue
        at = np.flatnonzero(word[:size] == word[third:])
        yield at, (letters[at] * LETTERS + letters[at + second]) * LETTERS + letters[at + third], DECAY ** (third + 1)


def _norms(starts: np.ndarray, total: int) -> np.ndarray:
    """Root of a word's kernel with itself, by its length, repeats aside."""
    sizes = np.diff(np.append(starts, total))
    squares = sum(np.maximum(0, sizes - third) * DECAY ** (2 * third + 2) for _, third in GAPS)
    return np.sqrt(np.maximum(squares, DECAY ** 6))


def word_scores(text: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each word, without the machine's offset, and what `symbols` gives."""
    letters, starts, sentences = symbols(text)
    if not len(starts):
        return np.empty(0), letters, starts, sentences
    sums = np.zeros(len(letters))
    for at, numbers, weight in _triples(letters):
        sums[at] += weight * weights[numbers]
    return np.add.reduceat(sums, starts) / _norms(starts, len(letters)), letters, starts, sentences


def _spell(letters: np.ndarray) -> str:
    return "".join(chr(96 + x) for x in letters.tolist())


def _unspell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
    return np.array([x for w in words for x in (0, *(ord(c) - 96 for c in w))], np.int64), starts


def features(words: list[str]) -> np.ndarray:
    """Normalised subsequence weights, one row of 32**3 for each word."""
    letters, starts = _unspell(words)
    found = np.zeros((len(words), LETTERS**3), np.float32)
    owner = np.cumsum(letters == 0) - 1
    for at, numbers, weight in _triples(letters):
        np.add.at(found, (owner[at], numbers), weight)
    found /= _norms(starts, len(letters))[:, None].astype(np.float32)
    return found


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of words (rows) with landmarks, given as rows of `features`."""
    table, out = np.ascontiguousarray(landmarks.T), np.zeros((len(words), len(landmarks)), np.float32)
    for first in range(0, len(words), 64):
        letters, starts = _unspell(words[first : first + 64])
        norms, places, numbers, weights = _norms(starts, len(letters)), [], [], []
        for at, number, weight in _triples(letters):
            places.append(at), numbers.append(number), weights.append(np.full(len(at), weight, np.float32))
        if places and len(np.concatenate(places)):
            at, number, weight = (np.concatenate(x) for x in (places, numbers, weights))
            owner = np.searchsorted(starts, at, side="right") - 1
            order = np.argsort(owner, kind="stable")
            owner, number, weight = owner[order], number[order], weight[order]
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[first + owner[begins]] = np.add.reduceat(table[number] * weight[:, None], begins, axis=0)
        out[first : first + len(norms)] /= norms[:, None].astype(np.float32)
    return out


def embed(words: list[str], chosen: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nystroem features of words, and the two matrices that lead from weights
    of these features to weights of landmarks, and on to those of subsequences."""
    by_subsequence = np.empty((LETTERS**3, len(chosen)), np.float32)  # as `kernel` reads them
    for at in range(0, len(chosen), 64):
        by_subsequence[:, at : at + 64] = features(chosen[at : at + 64]).T
    marks = by_subsequence.T
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T).astype(np.float32)
    return kernel(words, marks) @ root, root, marks


def machine(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features and an offset, by Newton steps on the squared
    hinge: each row of `x` is toxic and clean as often as the weights say, and
    both classes weigh alike."""
    toxic, clean = toxic / max(toxic.sum(), 1), clean / max(clean.sum(), 1)
    size = x.shape[1] + 1
    w = np.zeros(size)
    for _ in range(30):
        left, right = PENALTY * np.eye(size), np.zeros(size)
        left[-1, -1] *= 1e-6
        for at in range(0, len(x), 2048):
            part = np.hstack([x[at : at + 2048], np.ones((len(x[at : at + 2048]), 1))]).astype(np.float64)
            scores = part @ w
            up, down = toxic[at : at + 2048] * (scores < 1), clean[at : at + 2048] * (scores > -1)
            left += part.T @ ((up + down)[:, None] * part)
            right += part.T @ (up - down)
        new = np.linalg.solve(left, right)
        done = np.allclose(new, w, atol=1e-7)
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def with_letter(words: list[str]) -> list[str]:
    """Each word with one letter put in, after a place and with a letter that
    its own hash chooses."""
    out = []
    for w in words:
        number = crc32(w.encode())
        at = 1 + number % max(1, len(w) - 1)
        out.append(w[:at] + chr(97 + number // 64 % 26) + w[at:])
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, fold, toxic, clean): documents of each class and fold that hold a word."""
    for batch in batches:
        counts = {(fold, toxic): Counter() for fold in range(FOLDS) for toxic in (0, 1)}
        for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
            letters = symbols(text or "")[0]
            data = "".join(chr(96 + x) for x in letters.tolist())
            counts[fold, toxic].update(set(data[1:].split("`")) if data else ())
        for fold in range(FOLDS):
            words = list({*counts[fold, 0], *counts[fold, 1]})
            columns = [pa.array(words, pa.string()), pa.array([fold] * len(words), pa.int32())]
            columns += [pa.array([counts[fold, toxic][w] for w in words], pa.int64()) for toxic in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "fold", "toxic", "clean"])


def evidence(text: str, weights: np.ndarray, offset: float) -> tuple[float, float] | None:
    """What a text's words have above LEAST, and the highest score among them;
    nothing for a text without letters."""
    scores = word_scores(text, weights)[0]
    if not len(scores):
        return None
    scores = scores + offset
    return float(np.log(1e-3 + np.maximum(scores - LEAST, 0).sum() / len(scores) ** POWER)), float(np.clip(scores.max(), -1, 2))


def _evidence(shared):
    """Evidence of each text, by the machine that didn't see its fold, or by
    the last one for rows without a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = shared.value
        for batch in batches:
            fold = batch.column(2).to_pylist()
            found = [evidence(text or "", *machines[-1 if f is None else f]) for text, f in zip(batch.column(1).to_pylist(), fold)]
            columns = [pa.array([None if f is None else f[k] for f in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "sum", "top"])

    return run


def _curve(found: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic curve of evidence: by Newton steps
    with smoothed targets, classes as they are."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([found, np.ones((len(found), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (p - target) + 1e-2 * w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Table of subsequence weights, its offset, and the curve from evidence to
    likelihood."""

    def __init__(self, weights: np.ndarray | None, offset: float = 0.0, curve: tuple[float, ...] = (0.0, 0.0, 0.0)) -> None:
        self.weights, self.offset, self.curve = weights, offset, curve

    def likelihood(self, total: Column, top: Column) -> Column:
        """0 for texts without letters."""
        x = F.lit(self.curve[0]) * total + F.lit(self.curve[1]) * top + F.lit(self.curve[2])
        return F.coalesce(1 / (1 + F.exp(-x)), F.lit(0.0))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fitted on at most `max_rows` labelled rows that are not held out, those
    of smallest hash. Labels that are null go; of conflicting ones toxic
    counts. Without rows of both classes every score is 0."""
    spark = docs.sparkSession
    folder = own_folder(spark, "toxicity")
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so it can be broadcast
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")  # copies of a text stay together
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", fold, "toxic")
    rows = settle(rows, folder, "rows")
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model(None)
    counts = rows.select("text", "toxic", "fold").mapInArrow(_word_counts, "word string, fold int, toxic long, clean long")
    of = lambda side, f: F.sum(F.when(F.col("fold") == f, F.col(side)).otherwise(0)).alias(f"{side}{f}")
    sides = ("toxic", "clean")
    counts = counts.groupBy("word").agg(*(F.sum(side).alias(side) for side in sides), *(of(side, f) for side in sides for f in range(FOLDS)))
    counts = settle(counts, folder, "words")
    words = counts.filter((F.length("word") > 1) & (F.col("toxic") + F.col("clean") > 1))
    sums = words.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not sums["toxic"] or not sums["clean"]:
        return Model(None)
    # toxic documents that hold the word, as seen and as expected, in standard deviations
    share = sums["toxic"] / (sums["toxic"] + sums["clean"])
    expected = (F.col("toxic") + F.col("clean")) * share
    words = words.withColumn("preference", (F.col("toxic") - expected) / F.sqrt(expected * (1 - share)))
    preferred = words.orderBy(F.desc("preference"), "word").limit(MAX_PREFERRED).toArrow()
    others = words.orderBy(F.desc(F.col("toxic") + F.col("clean")), "word").limit(MAX_PREFERRED + MAX_OTHERS).toArrow()
    known_words = set(preferred["word"].to_pylist())
    new = [w not in known_words for w in others["word"].to_pylist()]
    both = pa.concat_tables([preferred, others.filter(pa.array(new, pa.bool_()))]).slice(0, MAX_PREFERRED + MAX_OTHERS)
    spelled, preference = both["word"].to_pylist(), both["preference"].to_numpy()
    rest = sorted(spelled[LANDMARKS // 2 :], key=lambda w: crc32(w.encode()))
    near = [i for i in range(min(INSERTED, len(preferred))) if len(spelled[i]) > 3 and preference[i] > 3]
    x, root, marks = embed(spelled + with_letter([spelled[i] for i in near]), spelled[: LANDMARKS // 2] + rest[: LANDMARKS // 2])
    machines = []
    for without in (*range(FOLDS), None):
        seen = {side: both[side].to_numpy() - (0.0 if without is None else both[f"{side}{without}"].to_numpy()) for side in sides}
        w, offset = machine(x, np.append(seen["toxic"], seen["toxic"][near] * INSERTED_WEIGHT), np.append(seen["clean"], np.zeros(len(near))))
        machines.append(((root @ w.astype(np.float32) @ marks).astype(np.float64), offset))
    del x, marks, both, preferred, others
    shared = spark.sparkContext.broadcast(machines)
    found = rows.select("doc_id", "text", "fold").mapInArrow(_evidence(shared), "doc_id long, sum double, top double")
    found = found.join(F.broadcast(chosen), "doc_id").filter("top IS NOT NULL").select("sum", "top", "toxic").toArrow()  # about max_rows
    curve = _curve(np.stack([found["sum"].to_numpy(), found["top"].to_numpy()], axis=1), found["toxic"].to_numpy().astype(float))
    return Model(*machines[-1], tuple(float(c) for c in curve))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of (doc_id, text). A null or empty text, or
    one without letters, scores 0; null doc_ids and repeated rows stay."""
    if model.weights is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast([(model.weights, model.offset)])
    rows = docs.select("doc_id", "text", F.lit(None).cast("int").alias("fold"))
    found = rows.mapInArrow(_evidence(shared), "doc_id long, sum double, top double")
    return found.select("doc_id", model.likelihood(F.col("sum"), F.col("top")).alias("score"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose score is below 0.5, with all their columns."""
    if model.weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.offset))

    @F.pandas_udf("sum double, top double")
    def found(texts: pd.Series) -> pd.DataFrame:
        values = [(evidence(text, *shared.value) if isinstance(text, str) else None) or (None, None) for text in texts]
        return pd.DataFrame(values, columns=["sum", "top"], dtype="float64")

    return docs.filter(let(found("text"), lambda f: model.likelihood(f["sum"], f["top"])) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`; other columns
    are ignored, an empty table gives no rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
