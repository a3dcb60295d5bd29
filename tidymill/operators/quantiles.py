"""Quantiles of columns, as a whole or by group: exact (linear interpolation) or from sketches.

Exact ones are read off the counted values of a group, put in order; a group is put in order as one only
up to a fixed number of values, beyond that by a distributed sort. Sketches merge and take one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import to_number
from ..functions.refs import col, cols, dtype
from .order import running_total

GROUP_VALUES = 1 << 18  # values of a group that are counted and put in order at once
FINE_SKETCH_SIZE = 3000  # k of the sketches that are the result
FINE_RANK_ERROR = 0.002


def _values(df: DataFrame, columns: Sequence[str], group_by: Sequence[str]) -> DataFrame:
    """(group..., column, value) rows of the non-null numbers."""
    pairs = [
        F.struct(F.lit(c).alias("column"), to_number(col(c), dtype(df, c)).alias("value"))
        for c in columns
    ]
    long = df.select(*cols(group_by), F.inline(F.array(*pairs)))
    return long.where(F.col("value").isNotNull())


def _interpolate(low: Column, high: Column, place: Column) -> Column:
    return low + (high - low) * (place - F.floor(place))


def _by_rank(counts: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from value counts by their rank: one range sort, no group in one task."""
    placed = running_total(counts, [*keys, "value"], "n", "__before")
    spans = placed.groupBy(*cols(keys)).agg(
        F.min("__before").alias("__start"), F.sum("n").alias("__total")
    )
    renamed = spans.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__start", "__total"
    )
    same_group = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    rows = placed.join(renamed, same_group, "inner")
    first = F.col("__before") - F.col("__start")
    picks, results = [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("__total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (first <= rank) & (rank < first + F.col("n"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"__{side}{i}"))
        results.append(_interpolate(F.col(f"__lo{i}"), F.col(f"__hi{i}"), place))
    picked = rows.groupBy(*cols(keys)).agg(*picks, F.first("__total").alias("__total"))
    return picked.select(*cols(keys), F.array(*results).alias("q"))


def _at_rank(counted: Column, rank: Column) -> Column:
    """The value at a 0-based rank of (value, n) in order."""
    walked = F.aggregate(
        counted, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("found")),
        lambda state, x: F.struct(
            (state["seen"] + x["n"]).alias("seen"),
            F.when((rank >= state["seen"]) & (rank < state["seen"] + x["n"]), x["value"]).otherwise(state["found"]).alias("found"),
        ),
    )
    return walked["found"]


def _interpolated(counted: Column, total: Column, p: Column) -> Column:
    place = p * (total - 1)
    return _interpolate(_at_rank(counted, F.floor(place)), _at_rank(counted, F.ceil(place)), place)


def _counted(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., inside, rows): the counted values of each group in order, and how many there are."""
    counts = values.groupBy(*cols(keys), "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*cols(keys)).agg(
        F.array_sort(F.collect_list(F.struct("value", "n"))).alias("inside"), F.sum("n").alias("rows")
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_by: Sequence[str] = (),
) -> DataFrame:
    """Rows (group..., column, q) with the array of exact quantiles of each numeric column.

    Equal values are counted first, on the map side. Groups of up to GROUP_VALUES numbers are put in
    order as they are; if any is larger, ranks are read off one distributed sort of the counted values.
    """
    keys = [*group_by, "column"]
    values = _values(df, columns, group_by)
    largest = values.groupBy(*cols(keys)).count().agg(F.max("count")).first()[0] or 0
    if largest > GROUP_VALUES:
        counts = values.groupBy(*cols(keys), "value").agg(F.count("*").alias("n"))
        return _by_rank(counts, keys, probs)
    q = F.array(*[_interpolated(F.col("inside"), F.col("rows"), F.lit(float(p))) for p in probs])
    return _counted(values, keys).select(*cols(keys), q.alias("q"))


def sketched_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_by: Sequence[str] = (),
) -> DataFrame:
    """The same rows from one pass: values whose share of smaller ones is right to about FINE_RANK_ERROR."""
    keys = [*group_by, "column"]
    sketches = _values(df, columns, group_by).groupBy(*cols(keys)).agg(
        F.kll_sketch_agg_double("value", FINE_SKETCH_SIZE).alias("sketch")
    )
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probs]
    return sketches.select(*cols(keys), F.array(*found).alias("q"))


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_by: Sequence[str] = (), approx: bool = False,
) -> DataFrame:
    return (sketched_quantiles if approx else exact_quantiles)(df, columns, probs, group_by)
