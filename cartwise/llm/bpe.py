"""Byte-pair encoding by speculation, and decoding.

Each distinct word is first cut greedily into the longest vocabulary entries.
A cut is the encoding exactly if every entry is what merging its own bytes
gives and no adjacent pair would have been merged otherwise; that test runs
for the pairs of all words at once, by undoing the later of the two merges
until the boundary is reached. Only words with a failing pair are merged one
rank after the other.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartwise.llm.pieces import BYTE_FILE, CACHE_WORDS, _byte_letters, byte_pieces, parts, special_ids, special_pattern, vocabulary_path
from cartwise.llm.registry import query
from cartwise.llm.shared import table

NEVER = np.int64(1) << 40


class Merges:
    """The vocabulary as bytes, and the merge that makes each token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back = _byte_letters()[1]
        plain = {entry: bytes(map(back.__getitem__, entry)) for entry in model["vocab"]}
        self.ids: dict[bytes, int] = {plain[entry]: number for entry, number in model["vocab"].items()}
        size = max(self.ids.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for entry, number in self.ids.items():
            self.bytes[number] = entry
        self.longest = max(map(len, self.ids))
        #: rank of the merge of two tokens, and by token: its rank and halves
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, np.int64)  # a single byte was never merged
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, merge in enumerate(model["merges"]):
            one, two = merge.split(" ") if isinstance(merge, str) else merge
            a, b = model["vocab"][one], model["vocab"][two]
            made = model["vocab"][one + two]
            self.ranks.setdefault((a, b), (rank, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        pairs = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        #: tokens that merging their own bytes gives
        self.whole = np.ones(size, bool)
        for number, entry in enumerate(self.bytes):
            if len(entry) > 1 and self.merge(entry) != [number]:
                self.whole[number] = False

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding: the pair of lowest rank first, leftmost first.

        Open pairs wait in a heap by (rank, place); tokens are linked to their
        neighbours, and a pair that has changed since is passed over.
        """
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        ranks, after = self.ranks, [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        open_ = [(ranks[pair][0], at, pair) for at, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(open_)
        while open_:
            _, at, pair = heapq.heappop(open_)
            next_ = after[at]
            if next_ < 0 or (ids[at], ids[next_]) != pair:
                continue
            ids[at], ids[next_] = ranks[pair][1], -1
            after[at] = after[next_]
            if after[at] >= 0:
                before[after[at]] = at
            for left, right in ((before[at], at), (at, after[at])):
                if left >= 0 and right >= 0 and (found := ranks.get((ids[left], ids[right]))):
                    heapq.heappush(open_, (found[0], left, (ids[left], ids[right])))
        return [number for number in ids if number >= 0]

    def greedy(self, word: bytes) -> list[int]:
        ids, at, out = self.ids, 0, []
        while at < len(word):
            for stop in range(min(len(word), at + self.longest), at, -1):
                found = ids.get(word[at:stop])
                if found is not None:
                    out.append(found)
                    at = stop
                    break
        return out

    def _rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_rank[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of tokens: does merging their bytes give just the two?

        Undoing merges from the last one back, the state before a merge has
        the halves that touch the boundary. The boundary stays open only if no
        merge across it comes before the one that was undone there.
        """
        good = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            across = self._rank_of_pairs(a, b)
            # a merge at the boundary happens if both sides exist before either is merged on:
            # on the left, an equal rank is taken first, as merges run from the left
            fails = (across < until_a) & (across < until_b) | (across == until_b) & (across < until_a)
            good[live[fails]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            undo_a = rank_a > rank_b
            undo_b = ~undo_a & (rank_b >= 0)
            on = ~fails & (undo_a | undo_b)
            until_a = np.where(undo_a, rank_a, until_a)[on]
            until_b = np.where(undo_b, rank_b, until_b)[on]
            a, b = np.where(undo_a, self.right[a], a)[on], np.where(undo_b, self.left[b], b)[on]
            live = live[on]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: speculate, verify all pairs at once, merge the rest."""
        guessed = [[self.ids[word]] if word in self.ids else self.greedy(word) for word in words]
        sizes = np.array([len(ids) for ids in guessed])
        flat = np.fromiter(chain.from_iterable(guessed), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        failed = np.zeros(len(words), bool)
        failed[word[~self.whole[flat]]] = True
        inner = word[1:] == word[:-1]
        left, right = flat[:-1][inner], flat[1:][inner]
        pairs, where = np.unique((left << 32) | right, return_inverse=True)
        failed[word[1:][inner][~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]]] = True
        for index in np.flatnonzero(failed).tolist():
            guessed[index] = self.merge(words[index])
        return guessed


@functools.cache
def merges() -> Merges:
    return Merges(vocabulary_path(BYTE_FILE))


class Codec:
    """Encodes and decodes whole texts; distinct words once per worker."""

    def __init__(self) -> None:
        self.merges, self.specials, self.pattern = merges(), special_ids(BYTE_FILE), special_pattern(BYTE_FILE)
        self.known: dict[str, list[int]] = {}
        table = self.merges.bytes + [b""] * (max(self.specials.values()) + 1 - len(self.merges.bytes))
        for text, number in self.specials.items():
            table[number] = text.encode()
        self.table = table

    def encode_all(self, texts: list[str | None], together: int = 256) -> Iterator[list[int]]:
        """Ids of each text; new words of `together` texts are cut at once."""
        for first in range(0, len(texts), together):
            cut = [
                [part if part in self.specials else byte_pieces(part) for part in parts(text or "", self.pattern)]
                for text in texts[first : first + together]
            ]
            words = set().union(*(part for text in cut for part in text if isinstance(part, list)))
            missing = list(words.difference(self.known))
            if missing and len(self.known) > CACHE_WORDS:
                self.known.clear()
                missing = list(words)
            if missing:
                self.known.update(zip(missing, self.merges.encode_words([word.encode() for word in missing])))
            for text in cut:
                yield [number for part in text for number in self._ids(part)]

    def _ids(self, part: str | list[str]) -> Iterable[int]:
        return (self.specials[part],) if isinstance(part, str) else chain.from_iterable(map(self.known.__getitem__, part))

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 give
        replacement characters."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec()
    digits = [str(number) for number in range(len(codec.table))]
    for batch in batches:
        counts, hashes, texts = [], [], []
        for ids in codec.encode_all(batch.column(1).to_pylist()):
            counts.append(len(ids))
            hashes.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
            texts.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec()
    for batch in batches:
        ids = list(codec.encode_all(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec()
    for batch in batches:
        texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, ids of each row of (doc_id, text); a null text has no ids."""
    return docs.select("doc_id", "text").mapInArrow(_encoded, "doc_id long, ids array<int>")


def decode(rows: DataFrame) -> DataFrame:
    """doc_id, text of each row of (doc_id, ids); null ids give an empty text."""
    return rows.select("doc_id", "ids").mapInArrow(_decoded, "doc_id long, text string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from
    them, for each row of (doc_id, text). Null and empty texts have no tokens
    and the digests of nothing; null doc_ids and repeated rows stay; other
    columns are ignored; an empty table gives no rows."""
    return docs.select("doc_id", "text").mapInArrow(_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op6_bpe_codec")
def op6_bpe_codec(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
