"""Near-duplicate documents by b-bit MinHash.

1. Each text's set of word shingles gives 128 minima. Of each minimum the low
   four bits of a mixed value are kept and packed, so a signature takes 64
   bytes; bands of four whole minima give 32 keys. Texts with one and the same
   set stand for one node from here on.
2. Nodes that share a band key are candidates. Two sets of similarity 0.8 share
   none of the keys with a probability of 5e-8.
3. The similarity of a candidate pair is estimated from the equal four-bit
   fields, corrected for chance collisions; pairs far below the threshold (6.5
   standard deviations) go, all others are confirmed on the full sets.
4. A key that thousands share does not give all pairs. Its members are held
   against one hub, their smallest member; members already joined need no more
   pairs. What remains apart within a key is compared in blocks of bounded
   size: signatures first, then full sets, and a block returns no more links
   than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.registry import query
from cartwise.llm.shared import forget, own_folder, settle, table
from cartwise.llm.shingles import mix, shingle_set

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
FIELDS = 0x1111111111111111  # the lowest bit of each four-bit field
BLOCK = 512
#: A list of ids up to this length (16 MB) is broadcast; a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20_240)
_LOW = (_random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_HIGH = (_random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the 128 hash functions over a set."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        values = _LOW * low[at : at + 2048] + _HIGH * high[at : at + 2048]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima."""
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, row])
    low = mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    packed = np.bitwise_or.reduce(low.reshape(-1, 64 // BITS) << shifts, axis=1)
    return keys.view(np.int64), packed.view(np.int64)


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, set_a, set_b = [], [], []
            bands = np.zeros((batch.num_rows, BANDS), np.int64)
            bits = np.zeros((batch.num_rows, MINIMA * BITS // 64), np.int64)
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = shingle_set(text, words)
                sizes.append(len(found))
                set_a.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)))
                set_b.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(77)), initial=np.uint64(0)).view(np.int64)))
                if len(found):
                    bands[row], bits[row] = signature(minima(found))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (bands, bits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), *lists],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"],
            )

    return run


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text, words).view(np.int64) for text in batch.column(1).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], names=["node", "shingles"])

    return run


def _least_matches(percent: int) -> int:
    """Fields that must match: what a pair at the threshold reaches but for one
    case in ten billion."""
    chance = 1 / (1 << BITS)
    share = percent / 100 + (1 - percent / 100) * chance
    return int(MINIMA * share - 6.5 * (MINIMA * share * (1 - share)) ** 0.5)


def similarity_estimate(matches: Column) -> Column:
    """Similarity from the number of matching fields, without the matches that
    chance alone gives."""
    chance = 1 / (1 << BITS)
    return (matches / MINIMA - chance) / (1 - chance)


def matching_fields(a: Column, b: Column) -> Column:
    """Fields in which two packed signatures agree."""

    def differing(x: Column, y: Column) -> Column:
        folded = x.bitwiseXOR(y)
        for step in (1, 2):
            folded = folded.bitwiseOR(F.shiftrightunsigned(folded, step))
        return F.bit_count(folded.bitwiseAND(F.lit(FIELDS)))

    return F.lit(MINIMA) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def _common(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, size of the intersection) for pairs of sorted sets: by a product
    of incidence tables where these are small, else set by set."""
    sizes = [len(x) for x in left], [len(x) for x in right]
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if len(both) * len(left) * len(right) > 2_000 * int(np.take(sizes[0], pairs[:, 0]).sum() + 1) or not len(both):
        for i, j in pairs.tolist():
            a, b = (left[i], right[j]) if sizes[0][i] <= sizes[1][j] else (right[j], left[i])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            yield i, j, int((b[at] == a).sum())
        return
    total = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(both), 4096):
        some = both[first : first + 4096]
        tables = []
        for side in (left, right):
            found = np.zeros((len(side), len(some)), np.float32)
            for row, values in enumerate(side):
                found[row] = np.isin(some, values[np.searchsorted(values, some[0]) : np.searchsorted(values, some[-1], "right")], assume_unique=True)
            tables.append(found)
        total += tables[0] @ tables[1].T
    for i, j in pairs.tolist():
        yield i, j, int(total[i, j])


def _compared(percent: int):
    """Links within a block, between its left and right members or, if it has
    no right ones, among the left ones; only such as join two parts."""
    least = _least_matches(percent)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["side", "node"], ignore_index=True)
        sides = [block[block["side"] == s].reset_index(drop=True) for s in (0, 1)]
        if not len(sides[1]):
            sides[1] = sides[0]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        (n1, c1, s1, b1), (n2, c2, s2, b2) = (
            (side["node"].to_numpy(), side["comp"].to_numpy(), side["n_shingles"].to_numpy(), np.stack(side["bits"].to_numpy()).view(np.uint64)) for side in sides
        )
        found = []
        for at in range(0, len(n1), 64):
            x = b1[at : at + 64, None, :] ^ b2[None, :, :]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            matches = MINIMA - np.bitwise_count(x & np.uint64(FIELDS)).sum(axis=2, dtype=np.int64)
            a, b = s1[at : at + 64, None], s2[None, :]
            good = (matches >= least) & (c1[at : at + 64, None] != c2[None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            if sides[0] is sides[1]:
                good &= n1[at : at + 64, None] < n2[None, :]
            i, j = np.nonzero(good)
            found.append(np.stack([i + at, j], axis=1))
        pairs, links = np.concatenate(found), []
        if len(pairs):
            sets = [[x for x in side["shingles"]] for side in sides]
            for i, j, both in _common(*sets, pairs):
                if 100 * both >= percent * (s1[i] + s2[j] - both) and (one := root(c1[i])) != (two := root(c2[j])):
                    parent[max(one, two)] = min(one, two)
                    links.append((n1[i], n2[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _blocks(mixed: DataFrame, folder: str) -> DataFrame:
    """(block, node, side) for the members (key, members, node) of keys that
    hold several components, so that any two members of a key meet.

    A node first belongs to its largest key, then to the largest of the groups
    so formed that it shares a key with; so a family of copies, whose keys are
    many, gives one large group and few others. Two groups meet if a key has
    members of both; large groups are cut into chunks of about BLOCK nodes.
    Every step is written before the next: as one plan its branches would be
    repeated in each other, hundreds of shuffles that the driver keeps at once.
    """
    own = mixed.groupBy("node").agg(F.max(F.struct("members", "key")).alias("_top")).select("node", F.col("_top.key").alias("g"))
    own = settle(own, folder, "block-keys")
    named = own.join(own.groupBy("g").agg(F.count("*").alias("size")), "g").select("node", F.struct("size", "g").alias("_group"))
    tops = mixed.select("key", "node").join(named, "node").groupBy("key").agg(F.max("_group").alias("_group"))
    own = mixed.select("key", "node").join(tops, "key").groupBy("node").agg(F.max("_group").alias("_group")).select("node", F.col("_group.g").alias("g"))
    own = settle(own, folder, "block-groups")
    sizes = own.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    own = settle(own.join(sizes, "g").withColumn("chunk", F.pmod(F.hash("node"), F.col("chunks"))), folder, "block-chunks")
    here = settle(mixed.select("key", "node").join(own, "node").select("key", "g", "chunks").distinct(), folder, "block-places")
    one, two = (here.select("key", F.col("g").alias(f"g{side}"), F.col("chunks").alias(f"n{side}")) for side in "12")
    meet = one.join(two, "key").filter("g1 <= g2").select("g1", "g2", "n1", "n2").distinct()
    meet = meet.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    meet = settle(meet.filter("g1 <> g2 OR i <= j").withColumn("block", F.xxhash64("g1", "g2", "i", "j")), folder, "block-pairs")
    place = lambda rows, g, chunk, side: rows.select("block", F.col(g).alias("g"), F.col(chunk).alias("chunk"), F.lit(side).alias("side"))
    sides = place(meet, "g1", "i", 0).unionByName(place(meet.filter("g1 <> g2 OR i <> j"), "g2", "j", 1))
    return sides.join(own.select("node", "g", "chunk"), ["g", "chunk"]).select("block", "node", "side")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, comp) for the ends of all edges (a, b): the smallest node that
    can be reached. Every node is tied to the smallest of its neighbours in
    turns, its larger ones first, then its smaller ones, until nothing changes;
    a turn is a keyed minimum and a join, and is written before the next."""
    spark = edges.sparkSession
    current = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}-0"
    )
    state, turn = None, 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        tied = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = tied.groupBy("u").agg(F.min("v").alias("m"))
        again = tied.join(low, "u")
        step = again.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(again.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        turn += 1
        step = settle(step, folder, f"{name}-{turn}")
        seen = step.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        forget(spark, folder, f"{name}-{turn - 1}")
        current = step
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return current.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


class _Links:
    """Confirmed links, and the components they give so far."""

    def __init__(self, nodes: DataFrame, full: DataFrame, folder: str, percent: int) -> None:
        self.nodes, self.full, self.folder, self.percent = nodes, full, folder, percent
        self.labels: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.turn = 0

    def comp(self, rows: DataFrame, node: str, comp: str) -> DataFrame:
        """`rows` with the component of the column `node`."""
        if self.labels is None:
            return rows.withColumn(comp, F.col(node))
        labels = self.labels.select(F.col("node").alias(node), F.col("comp").alias("_comp"))
        return rows.join(labels, node, "left").withColumn(comp, F.coalesce("_comp", node)).drop("_comp")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components."""
        if self.labels is None:
            return pairs
        return self.comp(self.comp(pairs, "a", "_a"), "b", "_b").filter("_a <> _b").drop("_a", "_b")

    def confirm(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b) whose full sets reach the threshold."""
        near = pairs
        for side in ("a", "b"):
            near = near.join(self.nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
        smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        near = near.filter((100 * smaller >= self.percent * larger) & (matching_fields(F.col("bits_a"), F.col("bits_b")) >= _least_matches(self.percent)))
        near = settle(near.select("a", "b"), self.folder, f"near-{self.turn + 1}")
        if self.labels is not None and near.isEmpty():
            return
        sets = near
        for side in ("a", "b"):
            sets = sets.join(self.full.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        both = F.size(F.array_intersect("set_a", "set_b"))
        links = sets.filter(100 * both >= self.percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")
        self.add(links)

    def add(self, links: DataFrame) -> None:
        """Add confirmed links (a, b) and find the components again."""
        self.turn += 1
        self.edges = links if self.edges is None else self.edges.unionByName(links)
        self.edges = settle(self.edges, self.folder, f"edges-{self.turn}")
        self.labels = settle(components(self.edges, self.folder, f"comps-{self.turn}"), self.folder, f"labels-{self.turn}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of (doc_id, text).

    Documents are linked if the sets of their `words`-word shingles reach a
    Jaccard similarity of `percent` hundredths; component_id is the smallest
    doc_id that can be reached. Texts that are null or hold no words have an
    empty set and no links. Rows with equal doc_ids count as one document; a
    row with a null doc_id takes no part: its component_id is null, and it is
    kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = own_folder(spark, "near-dedup")
    plain = docs.select("doc_id", "text")
    signed = settle(plain.mapInArrow(_signed(words), SIGNED), folder, "signed")
    key = ["n_shingles", "set_a", "set_b"]
    groups = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"))
    groups = settle(groups, folder, "groups")
    # of equal rows any will do; rows of one id with different texts are all candidates
    leaders = signed.join(groups, key).filter("doc_id = node").select("node", *key, "bands", "bits")
    leaders = settle(leaders.dropDuplicates(["node", *key]), folder, "leaders")
    nodes = leaders.select("node", "n_shingles", "bits")
    keyed = leaders.select(F.explode("bands").alias("key"), "node")
    hubs = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("hub")).filter("members > 1")
    shared = settle(keyed.join(hubs, "key"), folder, "shared")
    wanted = settle(shared.select(F.col("node").alias("doc_id")).distinct(), folder, "wanted")
    listed = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    full = settle(plain.join(listed, "doc_id", "left_semi").mapInArrow(_full(words), "node long, shingles array<long>"), folder, "full")

    links = _Links(nodes, full, folder, percent)
    # each node with its smallest hub, then with the others it is still apart from
    links.confirm(shared.filter("node <> hub").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")))
    links.confirm(links.apart(shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()))
    # what is left apart within a key, all against all in blocks
    placed = links.comp(shared.filter("members > 2"), "node", "comp")
    several = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    mixed = settle(placed.join(several, "key").select("key", "members", "node", "comp"), folder, "mixed")
    if not mixed.isEmpty():
        facts = mixed.select("node", "comp").distinct().join(nodes, "node").join(full, "node")
        blocks = settle(_blocks(mixed, folder), folder, "blocks").join(facts, "node")
        links.add(blocks.groupBy("block").applyInPandas(_compared(percent), "a long, b long"))

    labels = links.labels.select(F.col("node").alias("_node"), "comp")
    reached = groups.join(labels, F.col("node") == F.col("_node"), "left").select(*key, F.coalesce("comp", "node").alias("component_id"))
    linked = signed.select("doc_id", *key).join(reached, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT x, y FROM common UNION ALL SELECT y, x FROM common
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON s.doc_id = c.x
"""


@query("op2_near_duplicates", OP2_SQL)
def op2_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
