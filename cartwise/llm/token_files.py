"""Token ids as ORC files.

Rows are dealt into slices of the doc_id order, sorted within them and written
to one folder for each slice: integer run-length encoding for the ids, a row
index for every `INDEX_ROWS` rows and Bloom filters on doc_id. Number and
checksum of a document's ids stand beside them, so that what needs only these
reads no ids. Readers take stripes in parallel, and a search for documents
skips stripes by index and filter.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.llm.pieces import ByteIds
from cartwise.llm.registry import query
from cartwise.llm.shared import own_folder, sliced, table

END_ID = 2
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 2_000
SCHEMA = "doc_id long, ids array<int>, n_tokens long, crc32 long, slice long"


@functools.cache
def _encoder() -> ByteIds:
    """One for each worker, whose tasks share what it knows."""
    return ByteIds()


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, end = _encoder(), END_ID.to_bytes(4, "little")
    for batch in batches:
        found = [encoder.encode(text) + end for text in batch.column(2).to_pylist()]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        values = np.frombuffer(b"".join(found), "<i4")
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        sums = pa.array([zlib.crc32(x) for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(1), ids, pa.array(sizes), sums, batch.column(0)], names=["doc_id", "ids", "n_tokens", "crc32", "slice"])


def write_tokens(docs: DataFrame, path: str) -> None:
    """Ids of each row of (doc_id, text) with the end id, in ascending doc_id
    order (null first; equal ids by length, then by checksum) below `path`. A
    null or empty text has the end id alone; other columns are ignored."""
    number, slices = sliced(docs.select("doc_id"), "doc_id")
    # each slice is a task of its own; those without a doc_id are the last one
    task = F.when(F.col("slice") < 0, slices).otherwise(F.col("slice")).cast("int")
    dealt = docs.select(number.alias("slice"), "doc_id", "text").repartitionById(slices + 1, task)
    rows = dealt.mapInArrow(_encoded, SCHEMA).sortWithinPartitions("slice", "doc_id", "n_tokens", "crc32")
    rows.write.partitionBy("slice").options(**{
        "compression": "lz4", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_ROWS, "orc.bloom.filter.columns": "doc_id",
    }).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, crc32, slice of the files; with `doc_ids` only
    those, for which the reader skips stripes by their statistics and Bloom
    filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        ends = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
            names=["doc_id", "slice", "n_tokens", "ids_crc32"],
        )


def token_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that `read_tokens` gives; the
    last two from the ids themselves, and only they read them."""
    found = rows.select("doc_id", "ids", "slice").mapInArrow(_checked, "doc_id long, slice long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("slice").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # one row for each slice, 65,537 at most
    totals = rows.groupBy("slice").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(F.col("slice").alias("of"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))
    return placed.join(F.broadcast(shift), F.col("slice") == F.col("of")).select(
        "doc_id", (F.col("shift") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    path = own_folder(spark, "token-files") + "/ids"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digest(read_tokens(spark, path))
