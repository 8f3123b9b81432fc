"""Removal of repeated passages by suffix sorting.

A byte goes if a string of `LENGTH` bytes covers it that also starts earlier.
Suffixes are only sorted where that can decide something:

1. Every string of LENGTH bytes has an anchor: of the `GRAM`-byte strings within
   it the one of smallest hash, the first of equal ones. Equal strings have equal
   anchors. Neighbouring strings with one anchor make up a context, and contexts
   with the same bytes repeat each other wholly: all but the first are marked,
   within a batch before anything is shuffled, then between batches.
2. Of each distinct context the first one is left. Where an anchor has several,
   their bytes are fetched and dealt into buckets of anchors; an anchor with more
   than `CHUNK` contexts fills several buckets.
3. A bucket's suffixes are sorted in two stages: those smaller than their
   successors directly, all others by scanning the buckets of first bytes in
   ascending order, each suffix giving the place of the one before it. Adjacent
   suffixes with a common prefix of LENGTH bytes are repeats.
4. Of an anchor in several buckets the strings left in each are compared by
   digests of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.registry import query
from cartwise.llm.shared import own_folder, settle, table

LENGTH, GRAM = 100, 24
#: Contexts of one anchor, and on average of all, that are sorted in one bucket.
CHUNK = 2_000
#: Bytes that are hashed at once; longer texts are read in overlapping pieces.
PIECE = 1 << 20
#: A null doc_id comes last.
NO_ID = (1 << 63) - 1
MARK, CONTEXT, STRING = 1, 2, 3

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (8 + 16) bytes from each place on."""
    wide, power, parts = _LETTERS[data], int(_ODD[0]), {}
    for size in (1, 2, 4, 8):  # hashes of 2, 4, 8, 16 bytes
        wide = wide[:-size] * np.uint64(power) + wide[size:]
        power = power * power & (1 << 64) - 1
        parts[2 * size] = wide
    found = parts[8][: len(wide) - 8] * np.uint64(power) + wide[8:]
    found ^= found >> np.uint64(31)
    found *= _ODD[1]
    found ^= found >> np.uint64(29)
    return found


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of the LENGTH bytes from each place on, and all hashes."""
    hashes = gram_hashes(data)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    window, size = LENGTH - GRAM + 1, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def contexts(texts: list[bytes], piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, size, anchor, digest) of all contexts: `size` strings of
    LENGTH bytes from `start` on have the anchor."""
    pieces = [(n, at, text[at : at + piece + LENGTH - 1]) for n, text in enumerate(texts) for at in range(0, max(0, len(text) - LENGTH + 1), piece)]
    group, held = [], 0
    for number, part in enumerate(pieces):
        group.append(part)
        held += len(part[2])
        if held >= piece or number == len(pieces) - 1:
            yield _contexts(group)
            group, held = [], 0


def _contexts(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    joined = b"".join(piece for _, _, piece in group)
    place, hashes = anchors(np.frombuffer(joined, np.uint8))
    sizes = np.array([len(piece) for _, _, piece in group])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())  # strings within one text
    own = place[starts]
    new = np.append(True, own[1:] != own[:-1])
    low = starts[new]
    size = np.diff(np.append(np.flatnonzero(new), len(starts)))
    view = memoryview(joined)
    digest = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(low.tolist(), (low + size + LENGTH - 1).tolist())], np.uint64)
    piece = np.searchsorted(begins, low, side="right") - 1
    text = np.array([n for n, _, _ in group])[piece]
    shift = np.array([at for _, at, _ in group]) - begins
    return text, low + shift[piece], size, hashes[own[new]].view(np.int64), digest.view(np.int64)


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching stretches of each owner, joined."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    _, number = np.unique(owner, return_inverse=True)
    far = number * (int(stop.max()) + 2)  # so that stretches of different owners never touch
    reach = np.maximum.accumulate(stop + far)
    new = np.append(True, (start + far)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(owner)) - 1
    return owner[new], start[new], (reach - far)[last]


_ROWS = "kind int, anchor long, digest long, doc_id long, tie long, start long, size long"


def _batch(kind, anchor, digest, doc_id, tie, start, size) -> pa.RecordBatch:
    n = len(doc_id)
    full = lambda v: pa.array(np.broadcast_to(np.asarray(v, np.int64), n))
    columns = [pa.array(np.full(n, kind, np.int32)), *(full(v) for v in (anchor, digest, doc_id, tie, start, size))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "anchor", "digest", "doc_id", "tie", "start", "size"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of all texts, of those with equal bytes in a batch the first
    one, and marks where the others lie."""
    for batch in batches:
        doc_id, tie = (batch.column(i).to_numpy() for i in (0, 1))
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
        found = [np.concatenate(x) for x in zip(*contexts(texts))]
        if not found:
            continue
        text, start, size, anchor, digest = found
        order = np.lexsort((start, tie[text], doc_id[text], digest, anchor))
        text, start, size, anchor, digest = (x[order] for x in (text, start, size, anchor, digest))
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1]))
        yield _batch(CONTEXT, anchor[new], digest[new], doc_id[text[new]], tie[text[new]], start[new], size[new])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        same = (doc_id[text] == doc_id[text[first]]) & (tie[text] == tie[text[first]]) & (start == start[first])
        again = ~new & ~same  # a repeated row is no earlier string of itself
        owner, begin, end = merged(text[again], start[again], start[again] + size[again] + LENGTH - 1)
        spread = xxhash.xxh3_64_intdigest(batch.column(0).to_numpy().tobytes()) >> 1  # marks need no partition of their own
        yield _batch(MARK, (spread + np.arange(len(owner)) * 0x9E3779B97F4A7) % NO_ID, 0, doc_id[owner], tie[owner], begin, end - begin)


def _classes(chunk: int):
    """Rows in the order of anchor, digest and place: marks for all but the
    first of equal contexts, and the distinct contexts of anchors that have
    several, `digest` now being the number of the anchor's bucket. What a batch
    leaves open is kept for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first row of the last class, and its number within the anchor
        held = None  # the first class of the last anchor, if it is the only one so far
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(7)]
            marks = columns[0] == MARK
            yield _batch(MARK, *(c[marks] for c in columns[1:]))
            anchor, digest, doc_id, tie, start, size = (c[~marks] for c in columns[1:])
            if not len(anchor):
                continue
            if last is not None:  # the last class goes on as row 0
                anchor, digest, doc_id, tie, start, size = (np.append(np.int64(x), c) for x, c in zip(last[:6], (anchor, digest, doc_id, tie, start, size)))
            fresh_anchor = np.append(True, anchor[1:] != anchor[:-1])
            new = fresh_anchor | np.append(True, digest[1:] != digest[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            same = (doc_id == doc_id[first]) & (tie == tie[first]) & (start == start[first])
            again = ~new & ~same
            yield _batch(MARK, anchor[again], 0, doc_id[again], tie[again], start[again], size[again] + LENGTH - 1)
            at = np.flatnonzero(new)  # one row for each class
            opens = fresh_anchor[at]
            number = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            if last is not None:
                number[: np.append(np.flatnonzero(opens)[1:], len(at))[0]] += last[6]
            more = np.append(~opens[1:], False)  # another class of the anchor follows
            told = (number > 0) | more
            if last is not None:
                told[0] = held and more[0]  # told before, unless it was the only one
            rows = at[told]
            yield _batch(CONTEXT, anchor[rows], number[told] // chunk, doc_id[rows], tie[rows], start[rows], size[rows])
            end = at[-1]
            held = number[-1] == 0
            last = (*(int(c[end]) for c in (anchor, digest, doc_id, tie, start, size)), int(number[-1]))

    return run


def suffix_order(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes, sorted at least by their first `depth` bytes, in
    two stages."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    # smaller than its successor: the next byte that differs is larger; the end is smaller than any byte
    turn = np.append(np.flatnonzero(data[:-1] != data[1:]), n - 1)
    rises = np.append(data[:-1] < data[1:], False)
    direct = rises[turn[np.searchsorted(turn, np.arange(n))]]
    chosen = np.flatnonzero(direct)
    padded = np.append(data, np.zeros(depth, np.uint8))
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[chosen]).view(f"S{depth}").ravel()
    chosen = chosen[np.argsort(keys, kind="stable")]
    heads = np.searchsorted(data[chosen], np.arange(257))
    arrivals: list[list[np.ndarray]] = [[] for _ in range(256)]
    arrivals[data[-1]].append(np.array([n - 1]))
    out = []
    for byte in np.unique(data).tolist():
        bucket, wave = [], np.concatenate(arrivals[byte]) if arrivals[byte] else np.empty(0, np.int64)
        while len(wave):  # runs of one byte, step by step
            bucket.append(wave)
            before = wave - 1
            wave = before[(before >= 0) & (data[before] == byte)]
        bucket.append(chosen[heads[byte] : heads[byte + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        letters = data[before]
        before, letters = before[letters > byte], letters[letters > byte]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.append(True, letters[1:] != letters[:-1])) if len(letters) else []
        for a, b in zip(cuts, [*cuts[1:], len(letters)]):
            arrivals[letters[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes, up to `depth`, that each suffix of `order` but the first shares
    with the one before it; all have at least `depth` bytes."""
    rows = np.lib.stride_tricks.sliding_window_view(data, depth)
    out = np.empty(max(0, len(order) - 1), np.int64)
    for at in range(0, len(out), 65_536):
        one, two = rows[order[at : at + 65_536]], rows[order[at + 1 : at + 65_537]]
        differs = one[: len(two)] != two
        out[at : at + 65_536] = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
    return out


def _sorted_bucket(bucket: pa.Table) -> pa.Table:
    """Marks for strings of a bucket that start earlier in another context,
    and the first ones if others may lie in other buckets."""
    doc_id, tie, start = (bucket[c].to_numpy() for c in ("doc_id", "tie", "start"))
    anchor, many = bucket["anchor"].to_numpy(), bucket["many"].to_numpy()
    texts = bucket["bytes"].to_pylist()
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = np.arange(len(data)) - begins[owner] <= sizes[owner] - LENGTH
    order = suffix_order(data)
    order = order[whole[order]]
    group = np.cumsum(np.append(0, common_prefixes(data, order) < LENGTH))
    own = owner[order]
    place = start[own] + order - begins[own]
    ranked = np.lexsort((place, tie[own], doc_id[own], group))
    group, own, place, order = group[ranked], own[ranked], place[ranked], order[ranked]
    new = np.append(True, group[1:] != group[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = (doc_id[own] == doc_id[own[first]]) & (tie[own] == tie[own[first]]) & (place == place[first])
    again = ~new & ~same
    who, begin, end = merged(own[again], place[again], place[again] + LENGTH)
    out = [_batch(MARK, anchor[who], 0, doc_id[who], tie[who], begin, end - begin)]
    left = np.flatnonzero(new & many[own])
    digests = [xxhash.xxh3_128_digest(joined[a : a + LENGTH]) for a in order[left].tolist()]
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    out.append(_batch(STRING, halves[:, 0], halves[:, 1], doc_id[own[left]], tie[own[left]], place[left], LENGTH))
    return pa.Table.from_batches(out)


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, tie, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode("utf-8", "replace")
                for a in asked:
                    bucket = xxhash.xxh3_64_intdigest(a["anchor"].to_bytes(8, "little", signed=True), a["digest"]) % buckets
                    row = (bucket, a["anchor"], a["many"], doc_id, tie, a["start"], data[a["start"] : a["start"] + a["size"] + LENGTH - 1])
                    for column, value in zip(out, row):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["bucket", "anchor", "many", "doc_id", "tie", "start", "bytes"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its marks; a further copy of a row goes wholly."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc_id, text, copy, marks in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode("utf-8", "replace")
            if copy > 1 and len(data) >= LENGTH:
                marks = [{"start": 0, "size": len(data)}]
            start = np.array([m["start"] for m in marks or ()], np.int64)
            _, begin, end = merged(np.zeros(len(start), np.int64), start, start + np.array([m["size"] for m in marks or ()], np.int64))
            left, at = hashlib.sha256(), 0
            for a, b in zip(begin.tolist(), end.tolist()):
                left.update(data[at:a])
                at = b
            left.update(data[at:])
            for column, value in zip(out, (doc_id, len(data), int((end - begin).sum()), len(begin), left.hexdigest())):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, folder: str, repeated: bool, chunk: int = CHUNK) -> DataFrame:
    """doc_id, tie, marks (array of start and size, in bytes) of the documents
    that hold strings of LENGTH bytes which start earlier. With `repeated`,
    rows of one doc_id are told apart by a hash of their text, which also
    orders them."""
    rows = _keyed(docs, repeated)
    found = rows.select("doc_id", "tie", "text").mapInArrow(_folded, _ROWS)
    found = found.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc_id", "tie", "start")
    found = settle(found.mapInArrow(_classes(chunk), _ROWS), folder, "classes")
    asked = found.filter(F.col("kind") == CONTEXT)
    crowded = asked.filter("digest > 0").select("anchor").distinct().withColumn("many", F.lit(True))
    asked = asked.join(crowded, "anchor", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    buckets = max(1, -(-found.filter(F.col("kind") == CONTEXT).count() // chunk))
    # a document has fewer contexts than bytes
    asked = asked.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "digest", "many", "start", "size")).alias("asked"))
    texts = rows.join(asked, ["doc_id", "tie"]).select("doc_id", "tie", "text", "asked")
    cut = texts.mapInArrow(_cut(buckets), "bucket long, anchor long, many boolean, doc_id long, tie long, start long, bytes binary")
    sorted_ = settle(cut.groupBy("bucket").applyInArrow(_sorted_bucket, _ROWS), folder, "sorted")
    strings = sorted_.filter(F.col("kind") == STRING)
    first = strings.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "tie", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(first, ["anchor", "digest"]).filter(F.struct("doc_id", "tie", "start") != F.col("first"))
    marks = [x.filter(F.col("kind") == MARK).select("doc_id", "tie", "start", "size") for x in (found, sorted_)]
    marks = marks[0].unionByName(marks[1]).unionByName(later.select("doc_id", "tie", "start", "size"))
    return marks.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "size")).alias("marks"))


def _keyed(docs: DataFrame, repeated: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("tie"), text.alias("text")
    )


def remove_repeats(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of
    (doc_id, text), after each byte is taken out that a string of LENGTH bytes
    covers which also starts earlier.

    Null and empty texts have no bytes; texts shorter than LENGTH lose nothing.
    A null doc_id comes after all others. Rows of one doc_id are ordered by a
    hash of their text, and of rows that are the same one is the first. An
    empty table gives no rows; other columns are ignored. `chunk` bounds the
    contexts of one anchor in one bucket; the result doesn't depend on it.
    """
    folder = own_folder(docs.sparkSession, "repeats")
    repeated = bool(docs.groupBy("doc_id").count().filter("count > 1").head(1))
    marks = repeats(docs, folder, repeated, chunk)
    rows = _keyed(docs, repeated)
    rows = rows.join(marks, ["doc_id", "tie"], "left")
    copy = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("text")) if repeated else F.lit(1)
    rows = rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", copy.cast("int").alias("copy"), "marks")
    return rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query("op11_suffix_dedup", f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS p FROM d) x),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS place FROM g) x WHERE place > 1),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM (
    SELECT doc_id, p, sum(CAST(p > coalesce(before + {LENGTH}, -1) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run
    FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r) x) y GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS gap, a, b FROM runs
  UNION ALL SELECT doc_id, max(b), 1000000000, NULL FROM runs GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, sum(g.b - g.a) AS removed, count(g.b) AS spans, string_agg(substr(d.h, CAST(2 * gap + 1 AS BIGINT), CAST(2 * (a - gap) AS BIGINT)), '' ORDER BY a) AS h
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)""")
def op11_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
