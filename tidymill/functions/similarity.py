"""String similarity of two columns: shared bigrams, edit distance, and common root."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bigrams(c: Column) -> Column:
    """All runs of two characters, repeats included; empty for texts under two characters."""
    chars = F.split(c, "")
    n = F.size(chars)
    pairs = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda x, y: F.concat(x, y))
    return F.when(F.char_length(c) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def bigram_codes(c: Column) -> Column:
    """The bigrams as whole numbers, both characters' code points side by side."""
    points = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("bigint"))
    n = F.size(points)
    codes = F.zip_with(
        F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1),
        lambda x, y: x * F.lit(1 << 21) + y,
    )
    return F.when(F.char_length(c) >= 2, codes).otherwise(F.array().cast("array<bigint>"))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Share of bigrams of ``a`` that occur in ``b``, doubled, over both bigram counts.

    Repeats count on ``a`` only, so the score is not symmetric; callers put the smaller text
    first. It is held to 1.0. A text under two characters scores 1.0 when contained, else 0.
    """

    def score(p: Column) -> Column:
        shared = F.size(F.filter(p["ga"], lambda x: F.array_contains(p["gb"], x)))
        return F.least(F.lit(1.0), F.lit(2.0) * shared / (F.size(p["ga"]) + F.size(p["gb"])))

    # transform over one struct binds the two arrays, so that they are built once per pair
    both = F.array(F.struct(bigrams(a).alias("ga"), bigrams(b).alias("gb")))
    contained = F.when(F.contains(a, b) | F.contains(b, a), F.lit(1.0)).otherwise(F.lit(0.0))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0.0))
        .when((F.char_length(a) < 2) | (F.char_length(b) < 2), contained)
        .otherwise(F.transform(both, score)[0])
    )


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)
    )


def collapsed_root(c: Column) -> Column:
    """The text with runs of one character shortened to one; texts under three stay as they are."""
    return F.when(F.char_length(c) > 2, F.regexp_replace(c, r"(?s)(.)\1+", "$1")).otherwise(c)


def root_similarity(a: Column, b: Column) -> Column:
    """0.95 for equal collapsed roots, else 0.85, 0.80 or 0.75 for 4, 3 or 2 equal first characters."""
    score = F.when(collapsed_root(a) == collapsed_root(b), F.lit(0.95))
    shorter = F.least(F.char_length(a), F.char_length(b))
    for n, value in ((4, 0.85), (3, 0.80), (2, 0.75)):
        score = score.when((shorter >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n))), F.lit(value))
    return score.otherwise(F.lit(0.0))
