"""Token counts from pre-token frequencies.

Every distinct pre-token of the corpus is cut into pieces once. A document's
count is the sum over its pre-tokens of frequency times pieces; its ids are
never made. Pre-tokens follow a steep frequency law: those above a frequency
that at most `HOT` of them reach (each of at most `HOT_BYTES` bytes, so the
table has a proven bound) are looked up in a broadcast table, all others are
joined, so that no frequent pre-token becomes a hot join key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.pieces import WORD_FILE, library, mapped, parts, special_ids, special_pattern, word_pieces
from cartwise.llm.registry import query
from cartwise.llm.shared import own_folder, settle, table

HOT = 100_000
HOT_BYTES = 48
#: Frequencies are compared by eighths of a power of two.
STEPS = 8


def _frequencies(text: str | None) -> Counter:
    """Pre-tokens of one text; a special string counts as one of its own."""
    if not text:
        return Counter()
    if "<|" not in text:
        return Counter(word_pieces(text))
    counts: Counter = Counter()
    specials = special_ids(WORD_FILE)
    for part in parts(text, special_pattern(WORD_FILE)):
        if part in specials:
            counts["\n" + part] += 1  # a pre-token holds no white space, so this is no pre-token
        else:
            counts.update(word_pieces(part))
    return counts


def _batch_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            counts.update(_frequencies(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = library(WORD_FILE).model
    for batch in batches:
        tokens = [1 if p.startswith("\n") else len(model.tokenize(mapped(p))) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["piece", "n", "tokens"])


def _per_document(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = hot.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, ids, size, pieces, times = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = 0
                for piece, n in _frequencies(text).items():
                    tokens = known.get(piece)
                    if tokens is None:
                        rows.append(row), ids.append(None), size.append(None), pieces.append(piece), times.append(n)
                    else:
                        total += tokens * n
                # a line feed and a number: no pre-token, and another one for each row
                rows.append(row), ids.append(doc_id), size.append(len(text.encode()) if text else 0), pieces.append(f"\n{row}"), times.append(total)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(pieces, pa.string()), pa.array(times, pa.int64())],
                names=["row", "doc_id", "n_bytes", "piece", "n"],
            )

    return run


def piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n, tokens): every distinct pre-token, how often the texts hold
    it, and into how many tokens it is cut."""
    found = docs.select("text").mapInArrow(_batch_frequencies, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(_cut, "piece string, n long, tokens long")


def token_counts(docs: DataFrame, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of (doc_id, text).

    A null or empty text has 0 bytes and 0 tokens; a null doc_id and repeated
    rows give a row each; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    folder = own_folder(spark, "token-counts")
    pieces = settle(piece_counts(docs), folder, "pieces")
    step = F.floor(F.log2("n") * STEPS).cast("int")
    short = F.octet_length("piece") <= HOT_BYTES
    # at most a few hundred rows: one for each eighth of a power of two
    steps = sorted(pieces.filter(short).groupBy(step.alias("step")).count().collect(), reverse=True)
    least, reached = None, 0
    for row in steps:
        reached += row["count"]
        if reached > hot:
            break
        least = row["step"]
    frequent = [] if least is None else pieces.filter(short & (step >= least)).select("piece", "tokens").collect()  # at most `hot` rows of HOT_BYTES
    shared = spark.sparkContext.broadcast({row["piece"]: row["tokens"] for row in frequent})
    rows = docs.select("doc_id", "text").mapInArrow(_per_document(shared), "row long, doc_id long, n_bytes long, piece string, n long")
    counted = rows.join(pieces.select("piece", "tokens"), "piece", "left")
    return counted.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
