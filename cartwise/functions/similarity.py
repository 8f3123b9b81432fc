"""Trigram similarity of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.common import let


def ordered_trigrams(text: Column) -> Column:
    """Trigrams of the words of a text as they stand, each word padded with two
    spaces before and one after."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    per_word = F.transform(
        padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3)))
    )
    return F.flatten(per_word)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    return F.array_distinct(ordered_trigrams(text))


def set_similarity(left: Column, right: Column) -> Column:
    """Shared share of two distinct trigram arrays."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def trigram_similarity(left: Column, right: Column) -> Column:
    """Similarity of two texts in [0, 1]."""
    return set_similarity(trigrams(left), trigrams(right))


def word_similarity(query: Column, text: Column) -> Column:
    """Highest similarity between the trigram set of the query and any run of
    consecutive trigrams of the text. A best run starts and ends on a shared
    trigram, so only those are tried."""

    def best(wanted: Column, every: Column) -> Column:
        spots = F.filter(F.transform(every, lambda g, i: F.when(F.array_contains(wanted, g), i)), lambda i: i.isNotNull())

        def score(run: Column) -> Column:
            return let(F.size(F.array_intersect(run, wanted)), lambda shared: shared / (F.size(wanted) + F.size(F.array_distinct(run)) - shared))

        def from_(spots_: Column) -> Column:
            run = lambda i, j: F.slice(every, i + 1, j - i + 1)
            return F.array_max(F.transform(spots_, lambda i: F.array_max(F.transform(F.filter(spots_, lambda j: j >= i), lambda j: score(run(i, j))))))

        return let(spots, from_)

    both = F.struct(trigrams(query).alias("wanted"), ordered_trigrams(text).alias("every"))
    return F.coalesce(let(both, lambda b: best(b["wanted"], b["every"])), F.lit(0.0))
