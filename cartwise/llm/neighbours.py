"""Nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. The graph starts from random cuts of the space:
nodes on the same side of a few planes are compared with each other, several
times over. NN-descent then improves it: around each node its neighbours, and
those that have it as a neighbour, are compared with one another, as a
neighbour of a neighbour is likely to be one; this is a join of the graph with
itself in each round, and ends when few edges change. Distances are exact, and
nodes at equal distance are taken in the order of a hash. The lists of nodes
that lie near each other are compared in one task, which needs the vector of a
node once for all its lists.

A query is a row: its vector, the nearest `pool` nodes it has met, and the
nodes it need not meet again. It starts at its own node and follows, a few at a
time, the nearest nodes of its pool not yet followed, all queries together, one
round after the other, until every node of every pool has been followed. Only
nodes that a query hasn't met are compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.common import top_n
from cartwise.llm.registry import query
from cartwise.llm.shared import forget, own_folder, settle, table

NEIGHBOURS, REVERSE = 20, 20
TREES, LEAF = 12, 128
#: Share of new edges below which the graph is left as it is.
SETTLED = 0.02
#: Nodes whose lists are compared in one task, and bytes of the vectors that they can need.
CELL, CELL_BYTES = 1024, 64 << 20
#: Nodes a query keeps, and follows in a round.
POOL, STEP = 120, 30


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (double) of the rows that take part: no null id, no
    null, zero or non-finite vector or component, and of the most frequent
    length (the longer one of a tie)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select("vec_id", x.alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.filter(F.coalesce(good, F.lit(False)))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.size("vector") == (length["length"] if length else 0))


def _coded(width: str, planes: np.ndarray):
    """Vector as bytes of the type `width`, and the leaf of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            x = values.flatten().to_numpy().reshape(len(values), -1)
            bits = np.einsum("nd,tbd->ntb", x, planes) > 0
            leaves = (bits << np.arange(planes.shape[1])).sum(axis=2).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in x.astype(width)], pa.binary()), lists], names=["node", "code", "leaves"])

    return run


def _vectors(codes, width: str) -> np.ndarray:
    return np.frombuffer(b"".join(codes), width).reshape(len(codes), -1).astype(np.float64)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances. Where the difference of squares would lose digits,
    as between near copies, components are subtracted first."""
    squares = (x * x).sum(axis=1)
    sums = squares[:, None] + squares[None, :]
    d = sums - 2 * (x @ x.T)
    i, j = np.nonzero(~(d > 1e-8 * sums))
    for at in range(0, len(i), 8192):
        apart = x[i[at : at + 8192]] - x[j[at : at + 8192]]
        d[i[at : at + 8192], j[at : at + 8192]] = (apart * apart).sum(axis=1)
    return d


def _in_leaf(width: str):
    def run(leaf: pd.DataFrame) -> pd.DataFrame:
        node = leaf["node"].to_numpy()
        d = _distances(_vectors(leaf["code"].tolist(), width))
        np.fill_diagonal(d, np.inf)
        size = min(NEIGHBOURS // 2, len(node) - 1)
        near = np.argpartition(d, size - 1, axis=1)[:, :size] if size else np.empty((len(node), 0), int)
        return pd.DataFrame({"a": np.repeat(node, near.shape[1]), "b": node[near].ravel(), "d": np.take_along_axis(d, near, axis=1).ravel()})

    return run


def _local_join(width: str):
    """Pairs around each node of a cell that would improve one of the two; of
    two old neighbours of it nothing new can be learnt."""

    def run(lists: pa.Table, known: pa.Table) -> pa.Table:
        node, worst = known["node"].to_numpy(), known["worst"].to_numpy()
        x = _vectors(known["code"].to_pylist(), width) if len(node) else None
        order = np.argsort(node)
        around = lists["around"].combine_chunks()
        ends, items = around.offsets.to_numpy(), around.values
        place = order[np.searchsorted(node, items.field("node").to_numpy(), sorter=order)] if len(node) else None
        fresh = items.field("fresh").to_numpy(zero_copy_only=False)
        a, b, d = [], [], []
        for start, stop in zip(ends[:-1], ends[1:]):
            own, new = place[start:stop], fresh[start:stop]
            near = _distances(x[own])
            i, j = np.nonzero((new[:, None] | new[None, :]) & (near < worst[own][:, None]) & ~np.eye(len(own), dtype=bool))
            a.append(own[i]), b.append(own[j]), d.append(near[i, j])
        a, b, d = (np.concatenate(v) if v else np.empty(0, t) for v, t in ((a, np.int64), (b, np.int64), (d, np.float64)))
        _, one = np.unique(a * len(node) + b, return_index=True)
        one = one[np.lexsort((d[one], a[one]))]
        # NEIGHBOURS of these at most are known already, so that as many new ones are left
        one = one[np.arange(len(one)) - np.searchsorted(a[one], a[one]) < 2 * NEIGHBOURS]
        return pa.table({"a": node[a[one]], "b": node[b[one]], "d": d[one]})

    return run


def _closest(edges: DataFrame, key: str, n: int) -> DataFrame:
    """The n shortest edges at each node; of equally long ones no node is preferred everywhere."""
    return top_n(edges, key, n, F.col("d"), F.xxhash64("a", "b"), F.col("a"), F.col("b"))


def build_graph(nodes: DataFrame, folder: str, width: str = "<f8") -> DataFrame:
    """(a, b, d): about NEIGHBOURS near nodes b of each node a, for nodes
    (node, vector), whose components the numpy type `width` can hold."""
    seen = nodes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    n, size = seen["n"], seen["size"] or 1
    bits = max(1, int(np.log2(max(2, n / LEAF))))
    planes = np.random.default_rng(5).normal(size=(TREES, bits, size))
    coded = settle(nodes.select("node", "vector").mapInArrow(_coded(width, planes), "node long, code binary, leaves array<long>"), folder, "coded")
    placed = coded.select("node", "code", F.posexplode("leaves").alias("tree", "leaf"))
    counts = placed.groupBy("tree", "leaf").count()  # a crowded leaf is dealt out at random
    placed = placed.join(counts, ["tree", "leaf"]).withColumn("slot", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("count") / (2 * LEAF))))
    first = placed.select("tree", "leaf", "slot", "node", "code").groupBy("tree", "leaf", "slot").applyInPandas(_in_leaf(width), "a long, b long, d double")
    graph = _closest(first.groupBy("a", "b").agg(F.min("d").alias("d")), "a", NEIGHBOURS).withColumn("fresh", F.lit(True))
    graph = settle(graph, folder, "graph-0")
    # cells: the sides of the first planes of a tree, as many as leave about `cell` nodes
    cell = min(CELL, max(64, CELL_BYTES // ((NEIGHBOURS + REVERSE) * size * np.dtype(width).itemsize)))
    sides = 1 << max(0, min(bits, int(np.log2(max(1, n / cell)))))
    homes = coded.select("node", F.pmod(F.col("leaves")[0], F.lit(sides)).alias("side"))
    homes = homes.join(homes.groupBy("side").count(), "side").select(
        F.col("node").alias("v"), F.shiftleft("side", 32).bitwiseOR(F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / (2 * cell)))).alias("cell")
    )
    homes = settle(homes, folder, "homes")
    for turn in count(1):
        back = top_n(graph, "b", REVERSE, F.desc("fresh"), F.xxhash64("a", "b", F.lit(turn)), F.col("a"))
        around = graph.select(F.col("a").alias("v"), F.col("b").alias("node"), "fresh").unionByName(back.select(F.col("b").alias("v"), F.col("a").alias("node"), "fresh"))
        around = around.groupBy("v", "node").agg(F.max("fresh").alias("fresh"))
        lists = around.groupBy("v").agg(F.collect_list(F.struct("node", "fresh")).alias("around")).filter(F.exists("around", lambda x: x["fresh"]))  # NEIGHBOURS + REVERSE at most
        lists = settle(lists.join(homes, "v").select("cell", "around"), folder, f"lists-{turn}")
        worst = graph.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= NEIGHBOURS, F.max("d")).otherwise(float("inf")).alias("worst"))
        known = coded.select("node", "code").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        known = lists.select(F.col("cell").alias("for"), F.explode("around.node").alias("node")).distinct().join(known, "node").select("for", "node", "code", "worst")
        new = lists.groupBy("cell").cogroup(known.groupBy("for")).applyInArrow(_local_join(width), "a long, b long, d double").withColumn("fresh", F.lit(True))
        both = graph.withColumn("fresh", F.lit(False)).unionByName(new).groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
        graph = settle(_closest(both, "a", NEIGHBOURS), folder, f"graph-{turn}")
        forget(nodes.sparkSession, folder, f"graph-{turn - 1}"), forget(nodes.sparkSession, folder, f"lists-{turn}")
        changed = graph.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if changed is None or changed < SETTLED:
            break
    return graph.select("a", "b", "d")


def _packed(width: str):
    """Vectors as bytes of the type `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["node", "code"])

    return run


def _apart(width: str):
    """Distance of each node to the query that asks for it, from components in
    double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                difference = _vectors(batch.column(3).to_pylist(), width) - _vectors(batch.column(4).to_pylist(), width)
                d = pa.array(np.sqrt((difference * difference).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], d], names=["query_id", "home", "node", "d"])

    return run


def _search(asking: DataFrame, codes: DataFrame, links: DataFrame, folder: str, width: str, pool: int, step: int) -> DataFrame:
    """(query_id, d, node) of the pools of all queries (query_id, home, code);
    `home` is the node that a query starts at."""
    spark, key = asking.sparkSession, ["query_id", "home"]
    met = F.array().cast("array<struct<d:double,node:bigint,followed:boolean>>")
    state = asking.select(*key, "code", met.alias("pool"), F.array("home").alias("seen"), F.array("home").alias("fresh"))
    state = settle(state, folder, "state-0")
    for turn in count(1):
        asked = state.select(*key, F.col("code").alias("own"), F.explode("fresh").alias("node"))
        found = asked.join(codes, "node").select(*key, "node", "own", "code").mapInArrow(_apart(width), "query_id long, home long, node long, d double")
        # a query meets the links of `step` nodes at most
        found = found.groupBy(*key).agg(F.collect_list(F.struct("d", "node", F.lit(False).alias("followed"))).alias("found"))
        both = F.slice(F.array_sort(F.concat("pool", F.coalesce("found", met))), 1, pool)
        nearest_ = state.join(found, key, "left").select(*key, "code", "seen", both.alias("pool"))
        front = F.slice(F.transform(F.filter("pool", lambda x: ~x["followed"]), lambda x: x["node"]), 1, step)
        marked = F.transform("pool", lambda x: F.struct(x["d"], x["node"], (x["followed"] | F.array_contains("front", x["node"])).alias("followed")))
        nearest_ = nearest_.withColumn("front", front).withColumn("pool", marked)
        nearest_ = settle(nearest_, folder, f"pools-{turn}")
        near = nearest_.select(*key, F.explode("front").alias("node")).join(links, "node")
        near = near.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        nobody = F.array().cast("array<bigint>")
        fresh = F.array_except(F.coalesce("near", nobody), F.col("seen"))
        state = nearest_.join(near, key, "left").select(*key, "code", "pool", fresh.alias("fresh"), F.concat("seen", fresh).alias("seen"))
        state = settle(state, folder, f"state-{turn}")
        forget(spark, folder, f"state-{turn - 1}"), forget(spark, folder, f"pools-{turn}")
        if state.filter(F.size("fresh") > 0).isEmpty():
            # nothing new is near what was followed; nodes not followed yet may still lead on
            if state.filter(F.exists("pool", lambda x: ~x["followed"])).isEmpty():
                return state.select("query_id", F.explode("pool").alias("x")).select("query_id", "x.d", "x.node")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, pool: int = POOL, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each of `queries` (vec_id), rows of
    `vectors` themselves, the k nearest others (vec_id, embedding) that were
    found, by Euclidean distance, ties to the smaller vec_id.

    Rows that `usable` leaves out neither ask nor answer; equal rows count
    once; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    folder = own_folder(spark, "neighbours")
    rows = settle(usable(vectors).dropDuplicates(["vec_id", "vector"]), folder, "rows")
    # of equal vectors the k + 1 smallest ids are all that an answer can need
    members = top_n(rows, "vector", k + 1, F.col("vec_id"))
    members = members.groupBy("vector").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    nodes = settle(members.select("node", "vector", "members"), folder, "nodes")
    width = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    graph = build_graph(nodes, folder, width)
    back = _closest(graph, "b", REVERSE)
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(back.select(F.col("b").alias("node"), F.col("a").alias("other")))
    links = settle(both.groupBy("node").agg(F.collect_set("other").alias("near")), folder, "links")  # NEIGHBOURS + REVERSE at most
    codes = settle(nodes.select("node", "vector").mapInArrow(_packed(width), "node long, code binary"), folder, "codes")
    asking = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").join(nodes.select("node", "vector"), "vector")
    asking = asking.select(F.col("vec_id").alias("query_id"), "node").join(codes, "node").withColumnRenamed("node", "home")
    met = _search(asking, codes, links, folder, width, max(pool, k + 1), step)
    met = met.groupBy("query_id", "node").agg(F.min("d").alias("d"))
    answers = top_n(met, "query_id", k + 1, F.col("d"), F.col("node")).join(nodes.select("node", "members"), "node")
    answers = answers.select("query_id", "d", F.explode("members").alias("vec_id")).filter("vec_id <> query_id")
    ranked = top_n(answers, "query_id", k, F.col("d"), F.col("vec_id"), rank="rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
