"""Packing of token pieces into windows by multiway differencing.

Documents are cut at the window length; a full piece is a sequence by itself.
What remains is cut into shorter pieces, dealt by hash into groups of bounded
size, and every group is packed by Karmarkar-Karp: partial partitions, each of
as many windows as the group needs, are merged largest spread first, the
fullest windows of the one with the emptiest of the other, which leaves windows
of nearly equal length. If one exceeds the capacity, the group gets a further
window and is packed again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.pieces import ByteIds
from cartwise.llm.registry import query
from cartwise.llm.shared import own_folder, settle, table

WINDOW = 2048
END_ID = 1
#: Remainders are cut into pieces of at most so many ids: more pieces to a
#: window balance better.
SHORT = 512
#: Windows that a group fills, on average.
GROUP_WINDOWS = 128

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, number long"


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of `lengths` dealt to `windows` windows of nearly equal sums.

    A partial partition is a list of (sum, content), largest first; windows
    beyond its end are empty. Content is an index or a pair of contents.
    """
    if not lengths:
        return [[] for _ in range(windows)]
    heap: list = []
    for index, length in enumerate(lengths):
        heap.append((-length if windows > 1 else 0, index, [(length, index)]))
    heapq.heapify(heap)
    ticket = len(lengths)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        alone, extra = windows - len(two), len(one) + len(two) - windows
        if extra <= 0:
            merged = one + two
        else:  # opposite ends meet: the emptiest of the one with the fullest of the other
            met = [(a[0] + b[0], (a[1], b[1])) for a, b in zip(one[alone:], reversed(two[windows - len(one):]))]
            merged = one[:alone] + met + two[: windows - len(one)]
        merged.sort(key=lambda slot: -slot[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, ticket, merged))
        ticket += 1
    dealt = []
    for _, content in heap[0][2]:
        open_, indices = [content], []
        while open_:
            item = open_.pop()
            if isinstance(item, tuple):
                open_ += item
            else:
                indices.append(item)
        dealt.append(sorted(indices))
    return dealt + [[] for _ in range(windows - len(dealt))]


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing can keep within the capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        dealt = differencing(lengths, windows)
        if all(sum(lengths[i] for i in one) <= capacity for one in dealt):
            return [one for one in dealt if one]
        windows += 1


def _pieces(window: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part, number = ByteIds(), END_ID.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text) + end)
                total, at = len(ids) // 4, 0
                while at < total:
                    length = window if total - at >= window else min(short, total - at)
                    rows.append((doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, part, number))
                    at, number = at + length, number + 1
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECE.split(", ")])

    return run


def _packed(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "part", "number"], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = group["length"].tolist()
        order, sequence, offset = [], [], []
        first = int(group["bin"].iloc[0]) << 24
        for number, one in enumerate(fill(lengths, window)):
            at = 0
            for index in one:
                order.append(index), sequence.append(first + number), offset.append(at)
                at += lengths[index]
        out = group.iloc[order].assign(sequence_id=sequence, offset=offset)
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, window: int = WINDOW, short: int = SHORT, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row for each piece of each row of (doc_id, text): where it starts in
    its document, its length, checksum, the document's tokens with the end id,
    and its sequence and offset there.

    A null or empty text is one piece, the end id. A null doc_id and repeated
    rows are packed like others; other columns are ignored; an empty table
    gives no rows. Sequence ids are unique, not gapless.
    """
    spark = docs.sparkSession
    folder = own_folder(spark, "packing")
    pieces = settle(docs.select("doc_id", "text").mapInArrow(_pieces(window, short), PIECE), folder, "pieces")
    rest = pieces.filter(F.col("length") < window)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (window * group_windows)))
    dealt = rest.withColumn("bin", F.pmod(F.xxhash64("part", "number"), F.lit(groups)))
    packed = dealt.groupBy("bin").applyInPandas(
        _packed(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    # full pieces: numbered by partition and place, above all groups
    full = pieces.filter(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(1 << 62) + F.shiftleft("part", 38) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(full)


@query("op5_packing")
def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
