"""Personal data in texts: rules, and a character model that adds to them.

The rules find well-formed e-mail and IP addresses, card and phone numbers. A
bidirectional LSTM over characters with a CRF on top is trained, in numpy, on
spans that the rules label in the documents and on rewritten ones (an "(at)"
for the sign, other separators, a phone number without its country). It reads
overlapping windows wherever a text has a digit or a sign for "at"; what the
windows say of a character is averaged, and each stretch is decoded at once. A
decoded span is added if it touches no span of the rules and, with separators
put back to normal, is well-formed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.common import top_n
from cartwise.llm.registry import query
from cartwise.llm.shared import table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 64, 32, 24
HIDDEN, EMBEDDED = 16, 16
#: Stretches of each kind, and of no kind, that the model is trained on.
EXAMPLES = 300
#: Rewritten ones of each kind.
REWRITTEN = 240
EPOCHS, BATCH, RATE = 10, 48, 0.02

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.IGNORECASE)

Span = tuple[int, int, int]  # start, end, number of the kind


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    parts = [part.lstrip("0") for part in text.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the part before the sign starts with its run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done, 0
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the rules by start, then kind; code points, end exclusive."""
    if not text:
        return []
    spans = list(_emails(text)) if "@" in text else []
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((*m.span(), 2))
    if "." in text:
        spans += [(*m.span(), 1) for m in _IP.finditer(text) if _octets(m[0])]
    if "+" in text:
        spans += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


_AT = re.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+@\s*|\s*@\s+", re.IGNORECASE)
_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*", re.IGNORECASE)
_LOOSE_DOT = re.compile(r"\s*[(\[{]\.[)\]}]\s*|\s+\.\s*|\s*\.\s+")
_CARD_FORM = re.compile(r"[0-9]{3,6}(?:[ ./_-]{1,2}[0-9]{2,6}){2,5}")
_PHONE_FORM = re.compile(r"(?:00[0-9]{1,3}[ ./-])?\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}")


def well_formed(text: str, kind: int) -> bool:
    """Is a span of the model, with its separators put back, of its kind?"""
    if kind == 0:
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == 1:
        plain = _LOOSE_DOT.sub(".", text)
        return bool(_IP.fullmatch(plain)) and _octets(plain)
    digits = _digits(text)
    if kind == 2:
        return bool(_CARD_FORM.fullmatch(text)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(_PHONE_FORM.fullmatch(text)) and 10 <= len(digits) <= 15


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around its triggers, to the end of the runs of address
    characters that they cut. What has no digit, no @ and no "at" in brackets
    near it, such as an address written out in words, is not read."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        done = out[-1][1] if out else 0
        if m.end() + MARGIN <= done:
            continue
        start, end = max(0, m.start() - MARGIN), max(done, min(len(text), m.end() + MARGIN))
        while done < start and text[start - 1] in _LOCAL:
            start -= 1
        while end < len(text) and text[end] in _LOCAL:
            end += 1
        if out and start <= done:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_SIGNS = " \n.,-()[]{}@+_%/:=\"'"


def _symbols(text: str) -> np.ndarray:
    """Numbers of characters: letters without case, digits alike, some signs."""
    out, small = np.empty(len(text), np.int64), text.lower()
    if len(small) != len(text):  # some capitals have two characters as small ones
        small = "".join(c.lower()[:1] or c for c in text)
    for i, c in enumerate(small):
        out[i] = ord(c) - 96 if "a" <= c <= "z" else 27 if "0" <= c <= "9" else 28 + _SIGNS.index(c) if c in _SIGNS else 49 if c.isalpha() else 50
    return out


SYMBOLS, TAGS = 51, 1 + 2 * len(KINDS)  # 0 pads; tag 0 is outside, 1 + 2k begins kind k, 2 + 2k goes on


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for start, end, kind in sorted(spans, key=lambda s: s[0] - s[1]):
        if not out[start:end].any():
            out[start], out[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """BiLSTM-CRF over windows of characters."""

    def __init__(self, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        shape = {"e": (SYMBOLS, EMBEDDED), "o": (2 * HIDDEN, TAGS), "ob": (TAGS,), "t": (TAGS, TAGS), "s": (TAGS,)}
        for side in "fb":
            shape |= {f"{side}x": (EMBEDDED, 4 * HIDDEN), f"{side}h": (HIDDEN, 4 * HIDDEN), f"{side}c": (4 * HIDDEN,)}
        self.p = {k: random.normal(0, 0.2, v) if len(v) > 1 and k != "t" else np.zeros(v) for k, v in shape.items()}
        for side in "fb":
            self.p[f"{side}c"][HIDDEN : 2 * HIDDEN] = 1.0  # at first nothing is forgotten

    def _run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States of one direction, and what the way back needs."""
        p, (n, steps, _) = self.p, x.shape
        inputs = x @ p[f"{side}x"] + p[f"{side}c"]
        h, c, out, kept = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, steps, HIDDEN)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + h @ p[f"{side}h"]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((t, i, f, o, g, tc, *before))
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["e"][ids]
        both = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], axis=2)
        return both @ self.p["o"] + self.p["ob"]

    def _back(self, side: str, x: np.ndarray, kept: list, out: np.ndarray, grad: dict) -> np.ndarray:
        p, dx = self.p, np.zeros_like(x)
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        for t, i, f, o, g, tc, h0, c0 in reversed(kept):
            dh = dh + out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad[f"{side}x"] += x[:, t].T @ dz
            grad[f"{side}h"] += h0.T @ dz
            grad[f"{side}c"] += dz.sum(0)
            dx[:, t] = dz @ p[f"{side}x"].T
            dh, dc = dz @ p[f"{side}h"].T, dc * f
        return dx

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean loss per window and its gradient."""
        p, n, steps = self.p, *ids.shape
        x = p["e"][ids]
        (hf, kf), (hb, kb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate([hf, hb], axis=2)
        e = both @ p["o"] + p["ob"]
        a, b = np.zeros((n, steps, TAGS)), np.zeros((n, steps, TAGS))
        sums = lambda v, axis: np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis)) + v.max(axis)
        a[:, 0] = p["s"] + e[:, 0]
        for t in range(1, steps):
            a[:, t] = sums(a[:, t - 1, :, None] + p["t"], 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            b[:, t] = sums(p["t"] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        total = sums(a[:, -1], 1)
        at = np.arange(n)[:, None], np.arange(steps)[None, :], tags
        loss = total - e[at].sum(1) - p["t"][tags[:, :-1], tags[:, 1:]].sum(1) - p["s"][tags[:, 0]]
        de = np.exp(a + b - total[:, None, None])
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        pairs = np.exp(a[:, :-1, :, None] + p["t"] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grad["t"] = pairs.sum((0, 1))
        np.subtract.at(grad["t"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grad["s"] = de[:, 0].sum(0)
        np.subtract.at(grad["s"], tags[:, 0], 1)
        np.subtract.at(de, at, 1)
        grad["o"], grad["ob"] = np.einsum("nti,ntk->ik", both, de), de.sum((0, 1))
        dboth = de @ p["o"].T
        dx = self._back("f", x, kf, dboth[:, :, :HIDDEN], grad) + self._back("b", x, kb, dboth[:, :, HIDDEN:], grad)
        np.add.at(grad["e"], ids, dx)
        return float(loss.mean()), {k: v / n for k, v in grad.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        turn = 0
        for epoch in range(EPOCHS):
            order = random.permutation(len(ids))
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                _, grad = self.step(ids[rows], tags[rows])
                turn += 1
                for k, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-8)

    def decode(self, emissions: np.ndarray) -> np.ndarray:
        """Best tags of one stretch."""
        best, came = self.p["s"] + emissions[0], np.zeros((len(emissions), TAGS), np.int64)
        for t in range(1, len(emissions)):
            score = best[:, None] + self.p["t"]
            came[t] = score.argmax(0)
            best = score.max(0) + emissions[t]
        out = np.empty(len(emissions), np.int64)
        out[-1] = best.argmax()
        for t in range(len(emissions) - 1, 0, -1):
            out[t - 1] = came[t, out[t]]
        return out

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of each text: windows of all stretches together, averaged
        where they overlap, then one decoding for each stretch."""
        where, windows = [], []
        for number, text in enumerate(texts):
            for start, end in stretches(text):
                symbols = _symbols(text[start:end])
                first = len(windows)
                for at in range(0, max(1, len(symbols) - WINDOW + STRIDE), STRIDE):
                    windows.append(np.pad(part := symbols[at : at + WINDOW], (0, WINDOW - len(part))))
                where.append((number, start, end, first))
        found: list[list[Span]] = [[] for _ in texts]
        emitted = [self.emissions(np.stack(windows[at : at + 1024])).astype(np.float32) for at in range(0, len(windows), 1024)]
        emitted = np.concatenate(emitted) if emitted else np.zeros((0, WINDOW, TAGS), np.float32)
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)[:, None]
        for number, start, end, first in where:
            size = end - start
            total, seen = np.zeros((size + WINDOW, TAGS)), np.zeros((size + WINDOW, 1))
            for place, at in enumerate(range(0, max(1, size - WINDOW + STRIDE), STRIDE)):
                total[at : at + WINDOW] += weight * emitted[first + place]
                seen[at : at + WINDOW] += weight
            tags = self.decode(total[:size] / seen[:size])
            at = 0
            while at < size:
                if tags[at] % 2 == 1:
                    stop = at + 1
                    while stop < size and tags[stop] == tags[at] + 1:
                        stop += 1
                    found[number].append((start + at, start + stop, int(tags[at] - 1) // 2))
                    at = stop
                else:
                    at += 1
        return found


def _rewritten(text: str, kind: int, random: np.random.Generator) -> str:
    """A span as people write it who avoid the plain form."""
    pick = lambda *forms: forms[int(random.integers(len(forms)))]
    if kind == 0:
        text = text.replace("@", pick(" (at) ", " [at] ", "(at)", " @ "), 1)
        return text.replace(".", pick(".", ".", " [dot] "))
    if kind == 1:
        return text.replace(".", pick(" . ", "[.]", "(.)"))
    digits = _digits(text)
    if kind == 2:
        sign = pick(".", "/", "_", "  ")
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    sign = pick("-", ".", " ", "/")
    return pick(f"({last[:3]}) {last[3:6]}-{last[6:]}", sign.join((last[:3], last[3:6], last[6:])), f"001 {last[:3]} {last[3:6]} {last[6:]}")


def _invented(kind: int, random: np.random.Generator) -> str:
    digits = "".join(str(x) for x in random.integers(0, 10, 16))
    if kind == 0:
        word = lambda low, high: "".join(chr(97 + x) for x in random.integers(0, 26, int(random.integers(low, high))))
        name = word(2, 9) + ("", ".", "_", "-")[int(random.integers(4))] + (digits[:2], word(2, 8))[int(random.integers(2))]
        return name + "@" + ".".join(word(3, 9) for _ in range(int(random.integers(1, 3)))) + "." + word(2, 4)
    if kind == 1:
        return ".".join(str(x) for x in random.integers(1, 256, 4))
    if kind == 2:
        return next(digits[:15] + str(x) for x in range(10) if luhn(digits[:15] + str(x)))
    return f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:10]}"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with the first span's kind, or none, and all their spans."""
    for batch in batches:
        kinds, texts, spans = [], [], []
        for text in batch.column(0).to_pylist():
            if not text or not _TRIGGER.search(text):
                continue
            base = base_spans(text)
            for start, end in stretches(text):
                end = min(end, start + 2 * WINDOW)
                inside = [(a - start, b - start, k) for a, b, k in base if start <= a and b <= end]
                if any(a < end < b for a, b, _ in base):
                    continue
                kinds.append(inside[0][2] if inside else len(KINDS)), texts.append(text[start:end]), spans.append(written(inside))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, pa.string())], names=["kind", "stretch", "spans"])


def _parse(spans: str) -> list[Span]:
    return [(int(a), int(b), KINDS.index(kind)) for kind, a, b in (s.split(":") for s in spans.split(",") if s)]


def fit(docs: DataFrame) -> Tagger:
    """Trained on at most EXAMPLES stretches of each kind and of none, those of
    smallest hash over all documents, as they are and rewritten."""
    found = docs.select("text").mapInArrow(_examples, "kind int, stretch string, spans string").dropDuplicates(["stretch"])
    rows = top_n(found, "kind", EXAMPLES, F.xxhash64("stretch"), F.col("stretch")).collect()  # bounded: 1500 rows of 128 characters
    return learn([(r["kind"], r["stretch"], r["spans"]) for r in rows])


def learn(rows: list[tuple[int, str, str]]) -> Tagger:
    """A tagger from labelled stretches (kind, text, spans), and as many as
    REWRITTEN more of each kind: spans of the rows or invented ones, rewritten,
    in the surroundings that the rows have."""
    random, rows = np.random.default_rng(3), sorted(rows)
    around = [stretch for _, stretch, _ in rows] or ["the text around it, and so on", "und so weiter: der Text herum"]
    made = [(stretch, _parse(spans)) for _, stretch, spans in rows]
    for kind in range(len(KINDS)):
        known = [stretch[a:b] for k, stretch, spans in rows if k == kind for a, b, _ in _parse(spans)[:1]]
        for turn in range(REWRITTEN):
            text = known[turn // 3 % len(known)] if known and turn % 3 == 0 else _invented(kind, random)
            text = _rewritten(text, kind, random) if turn % 4 else text
            left, right = (re.sub("[0-9@+]", "e", around[int(random.integers(len(around)))]) for _ in range(2))
            left, right = left[-int(random.integers(8, 2 * MARGIN)) :] + " ", " " + right[: int(random.integers(8, 2 * MARGIN))]
            made.append((left + text + right, [(len(left), len(left) + len(text), kind)]))
    ids, tags = [], []
    for text, spans in made:
        symbols, wanted = _symbols(text), _tags(len(text), spans)
        for at in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE):
            part = slice(at, at + WINDOW)
            pad = WINDOW - len(symbols[part])
            ids.append(np.pad(symbols[part], (0, pad))), tags.append(np.pad(wanted[part], (0, pad)))
    model = Tagger()
    model.train(np.stack(ids), np.stack(tags))
    return model


def all_spans(texts: list[str | None], model: Tagger) -> Iterator[tuple[list[Span], list[Span]]]:
    """(spans of the rules, all spans) of each text."""
    some = [i for i, text in enumerate(texts) if text and _TRIGGER.search(text)]
    added = dict(zip(some, model.spans([texts[i] for i in some])))
    for number, text in enumerate(texts):
        base = base_spans(text) if number in added else []
        more = [
            s for s in added.get(number, ())
            if well_formed(text[s[0] : s[1]], s[2]) and not any(s[0] < end and start < s[1] for start, end, _ in base)
        ]
        yield base, sorted(base + more, key=lambda s: (s[0], s[2], s[1]))


def _found(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            counts, hashes, spans = [[] for _ in KINDS], [], []
            for base, every in all_spans(batch.column(1).to_pylist(), model.value):
                for kind, column in enumerate(counts):
                    column.append(sum(s[2] == kind for s in base))
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, the number of spans of the rules by kind, their digest, and all
    spans for each row of (doc_id, text). Null and empty texts have none; null
    doc_ids and repeated rows stay; other columns are ignored; an empty table
    gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return docs.select("doc_id", "text").mapInArrow(
        _found(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str | None, spans: list[Span]) -> str | None:
    """`text` with each span replaced by its kind; overlapping spans as one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """`docs` with all spans of `text` replaced by [EMAIL], [IP], [CARD] or
    [PHONE]; other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        values = [x if isinstance(x, str) else None for x in texts]
        return pd.Series([masked(t, every) for t, (_, every) in zip(values, all_spans(values, shared.value))], dtype=object)

    return docs.withColumn("text", hide("text"))


@query("op1_pii")
def op1_pii(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
