"""Ranked lexical search with hashed max-sketches.

A term's impact in a document grows with its frequency there and falls with the
document's length. A document's sketch has `WIDTH` cells; a term falls into the
cell of its hash, and a cell holds the largest impact that falls into it, so it
is never less than that of any term. For a block of items, the cells of their
terms are looked up in the sketch, times the weights of the terms: that gives
an upper bound of the document's score for every item of the block at once.

Documents are then scored exactly, for each item in descending order of their
bounds, until a bound lies below the item's lowest score among the best `k` so
far. Every task does so for its documents, and keeps what it has found from one
batch to the next; the best of all tasks are the best of all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.common import top_n
from cartwise.llm.registry import query
from cartwise.llm.shared import own_folder, settle, table

#: Characters between terms are ASCII signs and white space.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on the bytes of UTF-8: small letters, and a blank for what is no part of a term.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

WIDTH = 1 << 14
#: Items, and terms of items, that are searched in one pass over the documents.
BLOCK_ITEMS, BLOCK_TERMS = 256, 200_000
#: Documents whose sketches are compared at once.
GROUP = 256
#: Parts into which an item's finds are dealt before they meet.
PARTS = 64
NO_ID = 1 << 63


def split_terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_BYTES).split() if text else []


class Asked:
    """A block of items: their ids, terms, and weights once the corpus is known."""

    def __init__(self, rows) -> None:
        self.items: list = []
        self.terms: list[tuple[bytes, ...]] = []
        of: dict = {}
        for row in rows:
            of.setdefault(row["item_id"], set()).add(row["term"].encode("utf-8", "replace"))
        for item, terms in of.items():
            self.items.append(item), self.terms.append(tuple(sorted(terms)))
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for terms in self.terms for t in terms}))}
        self.weights: dict[bytes, int] = {}
        self.documents = self.length = 0

    def weigh(self, documents: int, length: int, found: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        self.weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(i, 0) + 1))) for t, i in self.vocabulary.items()}

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each cell that an item asks for (-1 for others), and the
        weights of the items' terms there."""
        place = np.full(WIDTH, -1, np.int32)
        wanted = np.unique([cell(t) for t in self.vocabulary])
        place[wanted] = np.arange(len(wanted))
        matrix = np.zeros((len(wanted), len(self.items)))
        for column, terms in enumerate(self.terms):
            for t in terms:
                matrix[place[cell(t)], column] += self.weights[t]
        return place, matrix


def cell(term: bytes) -> int:
    return crc32(term) & (WIDTH - 1)


def _statistics(shared):
    """(term, documents): of each asked term the documents that hold it; as -1
    the documents with terms, as -2 the terms of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        known, counts, documents, length = vocabulary.keys(), Counter(), 0, 0
        asked = set(known)
        for batch in batches:
            for text in batch.column(0):
                words = split_terms(text.as_py())
                documents += bool(words)
                length += len(words)
                counts.update(asked.intersection(words))
        terms = [vocabulary[t] for t in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *terms], pa.int64()), pa.array([documents, length, *counts.values()], pa.int64())], names=["term", "documents"]
        )

    return run


class Document:
    """Term frequencies of a text and its sketch: cells and largest impacts."""

    __slots__ = ("doc_id", "counts", "norm", "cells", "impacts")

    def __init__(self, doc_id, words: list[bytes], documents: int, length: int) -> None:
        self.doc_id, self.counts = doc_id, Counter(words)
        self.norm = 100 - 50 + (50 * len(words) * documents) // length
        cells = np.fromiter(map(crc32, self.counts), np.int64, len(self.counts)) & (WIDTH - 1)
        frequencies = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        impacts = (1_000_000_000 * frequencies) // (1000 * frequencies + 20 * self.norm)
        order = np.lexsort((impacts, cells))
        last = np.append(cells[order][1:] != cells[order][:-1], True)
        self.cells, self.impacts = cells[order][last], impacts[order][last]

    def exact(self, terms: tuple[bytes, ...], weights: dict[bytes, int]) -> int:
        counts, shift, score = self.counts, 20 * self.norm, 0
        for t in terms:
            times = counts.get(t)
            if times:
                score += weights[t] * ((1_000_000_000 * times) // (1000 * times + shift))
        return score


class Best:
    """The best `k` documents of each item so far."""

    def __init__(self, asked: Asked, k: int) -> None:
        self.asked, self.k = asked, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in asked.items]
        self.lowest = np.ones(len(asked.items))  # scores of 0 are no finds
        self.place, self.matrix = asked.cells()

    def bounds(self, group: list[Document]) -> np.ndarray:
        out = np.zeros((len(group), len(self.found)))
        for row, document in enumerate(group):
            place = self.place[document.cells]
            hit = place >= 0
            out[row] = document.impacts[hit].astype(np.float64) @ self.matrix[place[hit]]
        return out

    def add(self, group: list[Document]) -> None:
        bounds = self.bounds(group)
        for item in np.flatnonzero((bounds >= self.lowest).any(axis=0)).tolist():
            column, heap, terms = bounds[:, item], self.found[item], self.asked.terms[item]
            for row in np.argsort(-column, kind="stable").tolist():
                if column[row] < self.lowest[item]:
                    break
                document = group[row]
                score = document.exact(terms, self.asked.weights)
                entry = (score, -(NO_ID if document.doc_id is None else document.doc_id))
                if score > 0 and len(heap) < self.k:
                    heappush(heap, entry)
                elif score > 0 and entry > heap[0]:
                    heapreplace(heap, entry)
                if len(heap) == self.k:
                    self.lowest[item] = heap[0][0]


def _finds(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best, group = Best(asked, k), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_terms(text.as_py())
                if words:
                    group.append(Document(doc_id, words, asked.documents, asked.length))
                if len(group) == GROUP:
                    best.add(group)
                    group = []
        if group:
            best.add(group)
        for item, heap in zip(asked.items, best.found):
            if heap:
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(heap), pa.int64()), pa.array([None if -d == NO_ID else -d for _, d in heap], pa.int64()),
                    pa.array([s for s, _ in heap], pa.int64()),
                ], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: of each of `items` (item_id, text) the k
    documents (doc_id, text) of highest score above 0, equal ones by ascending
    doc_id, a null one last.

    Rows of one item_id, null included, are one item with the terms of all;
    every row of `docs` is a document, so repeated rows are found repeatedly.
    Null and empty texts have no terms: such items find nothing, and such
    documents are neither found nor counted. Empty tables give no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    folder = own_folder(spark, "lexical")
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term")).distinct()
    asked = settle(asked, folder, "asked")
    size = asked.agg(F.count("*").alias("terms"), F.countDistinct(F.coalesce("item_id", F.lit(-1))).alias("items")).first()
    blocks = max(-(-size["terms"] // BLOCK_TERMS), -(-size["items"] // BLOCK_ITEMS))
    number = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    found = []
    for at in range(blocks):
        block = Asked(asked.filter(number == at).collect())  # about BLOCK_TERMS short rows at most
        if not block.items:
            continue
        known = spark.sparkContext.broadcast(block.vocabulary)
        counts = docs.select("text").mapInArrow(_statistics(known), "term long, documents long")
        counts = {r["term"]: r["documents"] for r in counts.groupBy("term").agg(F.sum("documents").alias("documents")).collect()}  # at most the terms of the block
        if not counts.get(-2):
            continue
        block.weigh(counts[-1], counts[-2], counts)
        rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_finds(spark.sparkContext.broadcast(block), k), "item_id long, doc_id long, score long")
        found.append(settle(rows, folder, f"found-{at}"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = top_n(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["item_id", "part"], k, *order)
    ranked = top_n(rows.drop("part"), "item_id", k, *order, rank="rank")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS_SQL = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"


@query("op12_lexical_search", f"""
WITH words AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY 1, 2),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) x),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY 1) d, corpus),
scored AS (
  SELECT a.item_id, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * s.n * c.docs) // c.length)))) AS BIGINT) AS score
  FROM asked a JOIN tf t USING (term) JOIN weights w USING (term) JOIN sizes s ON s.doc_id = t.doc_id, corpus c GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) r
WHERE rank <= 50""")
def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
