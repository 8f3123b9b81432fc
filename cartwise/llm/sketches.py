"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs: its lines, and these after every pair of
neighbouring words whose hash meets a condition, so that an edit changes the
paragraphs it touches and no others. Every distinct
paragraph has a 64-bit digest, which goes into three cells, one of each third
of the sketch; a cell holds a count and the exclusive or of its digests and of
their check values. The fingerprint is the sketch of `CELLS` cells, written in
hexadecimal, after the number of paragraphs.

Two sketches are compared by subtracting cell from cell and peeling: a cell
with a single digest left gives it away, and the digest is taken out of its
other cells, until all is empty. What was peeled, digests and the side each is
on, is what the texts differ in. If cells are left, larger sketches are built
from the digests and peeled in the same way. A larger sketch is a row of
sketches of CELLS cells: the first bits of a digest choose which, so that its
cost follows the number of paragraphs. What of the row can't be peeled is tried
again at twice the size, until all is. Everything here is a
column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.common import let
from cartwise.llm.registry import query
from cartwise.llm.shared import sliced, table, text_or_empty

CELLS = 24
#: A word with the signs after it (of scripts without case a letter), signs alone, a line end.
WORD = r"(?:\p{Lo}|[\p{L}&&[^\p{Lo}]]+|\p{N}+)[^\p{L}\p{N}\n]*|[^\p{L}\p{N}\n]+|\n"
#: One pair of words in so many ends a paragraph.
EVERY = 8
#: Digests of both texts for each sketch of the first larger row, and how often rows are doubled.
LOAD, DOUBLED = 12, 7
ROUNDS = 24


def paragraph_digests(text: Column) -> Column:
    """Distinct paragraph digests, in ascending order."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    cut = let(words, lambda own: F.transform(own, lambda w, i: F.when(
        F.pmod(F.xxhash64(F.get(own, i - 1), w), F.lit(EVERY)) == 0, F.concat(w, F.lit("\n"))
    ).otherwise(w)))
    parts = F.filter(F.split(F.array_join(cut, ""), "\n"), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


THIRDS = ("x", "y", "z")
WIDTH = CELLS // len(THIRDS)


def _entry(digest: Column, n: Column, seed: Column | int) -> Column:
    """A digest with its check value and its cell in each third: other bits of
    the digest, or with a seed (a column) of its hash, choose each."""
    source = F.xxhash64(digest, seed) if isinstance(seed, Column) else digest
    at = [F.pmod(F.shiftrightunsigned(source, 20 * i), F.lit(WIDTH)).cast("int").alias(third) for i, third in enumerate(THIRDS)]
    return F.struct(n.alias("n"), digest.alias("k"), F.xxhash64(digest, F.lit(1)).alias("c"), *at)


def _merged(cell: Column, own: Column, sign: int) -> Column:
    """`cell` with the entries `own` added or taken out."""
    return F.aggregate(own, cell, lambda s, e: F.struct(
        (s["n"] + e["n"] if sign > 0 else s["n"] - e["n"]).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c")
    ))


def _own(entries: Column, third: str, index: Column) -> Column:
    return F.filter(entries, lambda e: e[third] == index)


def _cells(entries: Column) -> Column:
    """Three lists of WIDTH cells: (n, keys, checks) of the entries in each."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    places = F.sequence(F.lit(0), F.lit(WIDTH - 1))

    def third_of(own: Column, third: str) -> Column:
        return F.transform(places, lambda i: _merged(empty, _own(own, third, i), 1)).alias(third)

    return let(entries, lambda own: F.struct(*(third_of(own, t) for t in THIRDS)))


def sketch(digests: Column) -> Column:
    return _cells(F.transform(digests, lambda d: _entry(d, F.lit(1), 0)))


def tagged(one: Column, two: Column) -> Column:
    """The digests of two lists in ascending order, each with its side."""
    marked = lambda side: lambda d: F.struct(d.alias("digest"), F.lit(side).alias("side"))
    return F.array_sort(F.concat(F.transform(one, marked(1)), F.transform(two, marked(-1))))


def in_groups(every: Column, groups: Column) -> Column:
    """Ascending (digest, side) as lists, one for each of `groups` equal parts
    of the range of digests; parts without any are left out."""
    upper = lambda x: F.shiftrightunsigned(x["digest"].bitwiseXOR(F.lit(-(1 << 63))), 32)
    number = lambda x: F.shiftrightunsigned(upper(x) * groups, 32)

    def cut(numbers: Column) -> Column:
        begins = F.filter(F.transform(numbers, lambda x, i: F.when((i == 0) | (F.get(numbers, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda b, j: F.slice(every, b + 1, F.coalesce(F.get(at, j + 1), F.size(every)) - b)))

    return let(F.transform(every, number), cut)


def _minus(one: Column, two: Column) -> Column:
    less = lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c"))
    return F.struct(*(F.zip_with(one[t], two[t], less).alias(t) for t in THIRDS))


def _difference(every: Column, seed: Column) -> Column:
    """The sketch of the first side's digests less that of the second's, in one
    pass over both."""
    return _cells(F.transform(every, lambda x: _entry(x["digest"], x["side"], seed)))


_FOUND = "array<struct<digest:bigint,side:int>>"


def _peel(cells: Column, seed: Column | int = 0) -> Column:
    """The digests that two subtracted sketches differ in, `side` 1 for those
    of the first and -1 for those of the second; null if cells are left that no
    single digest fills."""
    start = F.struct(cells.alias("cells"), F.array().cast(_FOUND).alias("found"), F.lit(False).alias("stuck"))
    lone = lambda x: (F.abs(x["n"]) == 1) & (x["c"] == F.xxhash64(x["k"], F.lit(1)))

    def turn(s: Column) -> Column:
        found = F.concat(*(F.filter(s["cells"][t], lone) for t in THIRDS))
        # a digest may be alone in several cells
        pure = F.array_distinct(F.transform(found, lambda x: _entry(x["k"], x["n"], seed)))

        def rest(entries: Column, third: str) -> Column:
            return F.transform(s["cells"][third], lambda x, i: _merged(x, _own(entries, third, i), -1)).alias(third)

        return let(pure, lambda entries: F.struct(
            F.struct(*(rest(entries, t) for t in THIRDS)).alias("cells"),
            F.concat(s["found"], F.transform(entries, lambda e: F.struct(e["k"].alias("digest"), e["n"].alias("side")))).alias("found"),
            (F.size(entries) == 0).alias("stuck"),
        ))

    def clean(s: Column) -> Column:
        return F.forall(s["cells"]["x"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["stuck"], s).otherwise(turn(s)), lambda s: F.when(clean(s), s["found"])
    )


def paragraphs(text: Column) -> Column:
    """Digests of a text and the sketch that is its fingerprint."""
    return let(paragraph_digests(text), lambda d: F.struct(d.alias("digests"), sketch(d).alias("cells")))


def _turn(state: Column, attempt: Column) -> Column:
    """One attempt on what is open: a row of sketches, of which those that can
    be peeled give what they differ in, and the others stay open."""
    groups = F.call_function("shiftleft", F.ceil(state["size"] / LOAD).cast("long"), (attempt - 1).cast("int"))
    tried = let(groups, lambda g: F.transform(in_groups(state["open"], g), lambda x: F.struct(
        x.alias("own"), _peel(_difference(x, attempt), attempt).alias("found")
    )))

    def sorted_out(rows: Column) -> Column:
        left = F.flatten(F.transform(F.filter(rows, lambda r: r["found"].isNull()), lambda r: r["own"]))
        got = F.flatten(F.transform(F.filter(rows, lambda r: r["found"].isNotNull()), lambda r: r["found"]))
        return F.struct(left.alias("open"), F.concat(state["found"], got).alias("found"), state["size"].alias("size"))

    return let(tried, sorted_out)


def differing(one: Column, two: Column) -> Column:
    """The paragraph digests that two texts differ in, with their side: by
    their fingerprints, else by larger and larger sketches. Null if not even
    rows doubled `DOUBLED` times can be peeled, whose sketches hold a tenth of a
    digest on average."""
    nothing = F.array().cast(_FOUND)

    def search(own: Column) -> Column:
        every = tagged(own["one"]["digests"], own["two"]["digests"])
        start = F.struct(every.alias("open"), nothing.alias("found"), F.size(every).alias("size"))
        larger = let(start, lambda begun: F.aggregate(
            F.sequence(F.lit(1), F.lit(DOUBLED + 1)), begun, lambda s, attempt: F.when(F.size(s["open"]) == 0, s).otherwise(_turn(s, attempt)),
            lambda s: F.when(F.size(s["open"]) == 0, s["found"]),
        ))
        return F.coalesce(_peel(_minus(own["one"]["cells"], own["two"]["cells"])), larger)

    return let(F.struct(one.alias("one"), two.alias("two")), search)


def likeness(one: Column, two: Column) -> Column:
    """Shared paragraphs by all paragraphs of two texts; 1 for two empty ones.
    The lists of digests decide only if no sketch could be peeled."""
    both = (F.size(one["digests"]) + F.size(two["digests"])).cast("double")
    listed = F.size(F.array_except(one["digests"], two["digests"])) + F.size(F.array_except(two["digests"], one["digests"]))
    apart = let(differing(one, two), lambda found: F.when(found.isNotNull(), F.size(found)).otherwise(listed))
    return F.when(both == 0, F.lit(1.0)).otherwise(let(apart, lambda n: (both - n) / (both + n)))


def fingerprint(of: Column) -> Column:
    """The sketch of `CELLS` cells as text."""
    cell = lambda x: F.concat(F.hex(x["n"]), F.lit("."), F.hex(x["k"]), F.lit("."), F.hex(x["c"]))
    cells = F.concat(*(of["cells"][third] for third in THIRDS))
    return F.concat(F.size(of["digests"]).cast("string"), F.lit(":"), F.array_join(F.transform(cells, cell), ","))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, its `own` paragraphs and, as `next`, text and `own` of the document that
    follows in descending doc_id (after the last one the first).

    Rows are dealt into slices of the doc_id order. A slice also gets the first
    row of the slice below it, as a guest, so that the text moves once and no
    slice needs another. Equal ids: by text. Rows with a null doc_id come last.
    """
    ids = docs.select(F.col("doc_id").alias("doc_id"))
    number, slices = sliced(ids, "doc_id", rows=1024)
    # 65,537 rows at most: the greatest id of each slice, shown to the slice above
    tops = ids.groupBy(number.alias("slice")).agg(F.max("doc_id").alias("top"))
    above = Window.orderBy("slice")
    host = F.coalesce(F.lead("slice").over(above), F.first("slice").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = tops.select(F.col("slice").alias("_slice"), F.col("top").alias("_top"), host.alias("host"), (F.lead("slice").over(above).isNull()).alias("wrap"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), number.alias("slice"))
    rows = rows.join(F.broadcast(guests), (F.col("slice") == F.col("_slice")) & F.col("doc_id").eqNullSafe(F.col("_top")), "left")
    at = F.array(F.struct(F.col("slice").alias("slice"), F.lit(0).alias("guest")))
    also = F.array(F.struct(F.col("host").alias("slice"), F.when(F.col("wrap"), 2).otherwise(1).alias("guest")))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), at).otherwise(F.concat(at, also))).alias("p"))
    order = Window.partitionBy("p.slice").orderBy("p.guest", F.desc_nulls_last("doc_id"), "text")
    rows = rows.repartition(slices + 1, F.col("p.slice")).select("doc_id", "text", "p", paragraphs(F.col("text")).alias("own"))
    follows = F.lead(F.struct("text", "own")).over(order)
    return rows.select("doc_id", "text", "own", follows.alias("next"), F.col("p.guest").alias("guest")).filter("guest = 0").drop("guest")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each row of (doc_id, text) with its edited text: the last third of its
    code points replaced by as many first ones of the next document.

    Null texts are empty; an empty text has the fingerprint of no paragraphs,
    and its edited text is empty; a table of one row is followed by itself;
    repeated rows follow one another; other columns are ignored.
    """
    rows = with_next(docs)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("next"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", paragraphs(F.col("edited")).alias("edited"), "next")
    own, edited, following = F.col("own"), F.col("edited"), F.col("next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
    )


@query("op3_fingerprints")
def op3_fingerprints(spark, sf_dir):
    return edited_pairs(table(spark, sf_dir, "documents"))
