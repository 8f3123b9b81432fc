"""Whitening of embeddings by a weighted covariance of distinct vectors.

Components are put on a grid of whole numbers (256 to one), and equal grid
vectors are one row with a count. Means and covariance are those of the
distinct vectors, each weighing as often as it occurs or once: sums are exact
whole numbers, and the covariance is a matrix product of the weighted centred
rows of each partition, added up over partitions. Every distinct vector is
whitened once, and its result is joined back to all rows that hold it; the few
vectors that hold a large share of the rows are joined by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.registry import query
from cartwise.llm.shared import own_folder, settle, table

GRID = 256
#: Grid values beyond this leave the vector out: they could not be added up exactly.
LARGEST = 1 << 40
#: A vector is joined by broadcast if it holds more than one in so many rows, so there are fewer than these.
HOT = 256
COMPONENTS = 4
#: Eigenvalues below this share of the trace are no variance but rounding.
NOTHING = 1e-13


def on_grid(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the rows whose vector is not null and has
    only finite components within the grid, and the most frequent length (the
    longer one of a tie). Rows with a null vec_id and repeated rows stay."""
    numbers = F.transform("embedding", lambda v: v.cast("double") * GRID)
    rows = vectors.select("vec_id", numbers.alias("scaled"))
    fit = F.forall("scaled", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= float(LARGEST)))
    rows = rows.filter(F.col("scaled").isNotNull() & F.coalesce(fit, F.lit(False)))
    length = rows.groupBy(F.size("scaled").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size("scaled") == (length["length"] if length else -1))
    return rows.select("vec_id", F.transform("scaled", lambda v: F.floor(v).cast("long")).alias("x"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _sums(size: int):
    """Weighted sum of each dimension, exact, one row per dimension and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * size
        for batch in batches:
            if batch.num_rows:
                x, weight = _matrix(batch.column(0), size), batch.column(1).to_numpy()
                small = int(np.abs(x).max(initial=0)) * int(weight.sum()) < 1 << 62
                part = weight @ x if small else weight.astype(object) @ x.astype(object)
                totals = [a + int(b) for a, b in zip(totals, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], names=["dimension", "total"]
        )

    return run


def _products(mean: np.ndarray):
    """Upper triangle of the weighted product of centred rows, one for each partition."""
    size = len(mean)
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            centred = _matrix(batch.column(0), size) - mean
            total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "total"])

    return run


def _whitened(n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray):
    """Exact deviation and whitened components of each distinct vector."""
    size = len(sums)

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
        if reach * reach * size < 1 << 63:
            apart = n * x - np.array(sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        found = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), size)
            z = (x - mean) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(deviations(x), pa.int64()), lists], names=["x", "times", "deviation", "z"])

    return run


def covariance(distinct: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """Weight, sums and covariance of (x, weight) rows; `size` squared numbers
    reach the driver, however many rows there are."""
    n = int(distinct.agg(F.sum("weight")).first()[0])
    rows = distinct.select("x", "weight")
    found = rows.mapInArrow(_sums(size), "dimension int, total decimal(38,0)").groupBy("dimension").agg(F.sum("total").alias("total")).collect()
    sums = [int(r["total"]) for r in sorted(found, key=lambda r: r["dimension"])]
    mean = np.array([s / n for s in sums])
    products = rows.mapInArrow(_products(mean), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    v = np.zeros((size, size))
    for r in products:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["total"] / n
    return n, sums, v


def _identity_error(distinct: DataFrame, n: int, live: int) -> float:
    """Largest entry of the covariance of whitened vectors minus the identity."""
    if not live:
        return 0.0
    z = [F.col("z")[k] for k in range(live)]
    means = distinct.agg(*((F.sum(F.col("weight") * c) / n).alias(f"m{k}") for k, c in enumerate(z))).first()
    pairs = [(a, b) for a in range(live) for b in range(a, live)]
    sums = distinct.agg(*((F.sum(F.col("weight") * (z[a] - means[a]) * (z[b] - means[b])) / n).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(sums[at] - (a == b)) for at, (a, b) in enumerate(pairs))


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for
    each row of (vec_id, embedding) that `on_grid` keeps and each of the first
    `components`, at most as many as dimensions.

    `weights` is "one", where each distinct vector counts once, or "count",
    where it counts as often as it occurs. A component without variance has
    null as whitened value, and explained is null where nothing varies; a
    deviation beyond a long is null. Repeated rows give repeated results, an
    empty table, or vectors without dimensions, no rows; other columns are
    ignored.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are 'one' or 'count'")
    spark = vectors.sparkSession
    folder = own_folder(spark, "whitening")
    rows = on_grid(vectors)
    times = rows.groupBy("x").agg(F.count("*").alias("times"))
    distinct = settle(times, folder, "distinct")
    seen = distinct.agg(F.sum("times").alias("rows"), F.max(F.size("x")).alias("size")).first()
    size = seen["size"] or 0
    if not size:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    weighted = distinct.withColumn("weight", F.col("times") if weights == "count" else F.lit(1).cast("long"))
    n, sums, v = covariance(weighted, size)
    values, vectors_ = np.linalg.eigh(v)
    kept = min(components, size)
    values, axes = values[::-1][:kept], vectors_[:, ::-1][:, :kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    live = int((values > NOTHING * trace).sum()) if trace > 0 else 0
    scaled = axes[:, :live] / np.sqrt(values[:live])
    mean = np.array([s / n for s in sums])
    done = distinct.select("x", "times").mapInArrow(_whitened(n, sums, mean, scaled), "x array<long>, times long, deviation long, z array<double>")
    done = settle(done, folder, "whitened")
    error = _identity_error(done.withColumn("weight", F.col("times") if weights == "count" else F.lit(1)), n, live)
    results = F.array(*[
        F.struct(
            F.lit(k + 1).alias("component"), F.get("z", F.lit(k)).alias("whitened"),
            F.lit(float(values[k]) / trace if trace > 0 else None).cast("double").alias("explained"),
        )
        for k in range(kept)
    ])
    hot = done.filter(F.col("times") > math.floor(seen["rows"] / HOT))  # fewer than HOT vectors
    common = rows.join(F.broadcast(hot), "x")
    rare = rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(done, "x")
    both = common.unionByName(rare).select("vec_id", "deviation", F.inline(results).alias("component", "whitened", "explained"))
    return both.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
