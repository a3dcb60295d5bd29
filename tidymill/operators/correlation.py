"""Pearson, Spearman and Kendall tau-b over the rows where both columns hold a number.

Fewer than two such rows give 0.0, a column without variance gives null. Spearman and Kendall
work on counted values, so copies never reach a sort.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import to_number
from ..functions.refs import col, dtype
from ..scratch import write_out
from .order import global_row_index, running_total

# Rows of one Kendall block: what one task sorts in memory.
BLOCK_ROWS = 50_000


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(to_number(col(a), dtype(df, a)).alias("a"), to_number(col(b), dtype(df, b)).alias("b"))
    return both.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def _guarded(n: Column, r: Column, name: str) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(r).alias(name)


def corr_pearson(df: DataFrame, a: str, b: str, name: str = "result") -> DataFrame:
    x, y = F.col("a"), F.col("b")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return _pairs(df, a, b).agg(_guarded(F.count("*"), r, name))


def corr_spearman(df: DataFrame, a: str, b: str, name: str = "result") -> DataFrame:
    """Pearson on average ranks, weighted by how often each pair of values occurs."""
    pairs = _pairs(df, a, b).groupBy("a", "b").agg(F.count("*").alias("w"))
    pairs = write_out(pairs, "spearman")
    totals = pairs.agg(F.sum("w").alias("n")).first()
    middle = F.lit(((totals["n"] or 0) + 1) / 2.0)

    def ranks(side: str) -> DataFrame:
        counts = pairs.groupBy(F.col(side).alias(f"v{side}")).agg(F.sum("w").alias("n"))
        placed = running_total(counts, [f"v{side}"], "n", "before")
        rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
        return placed.select(f"v{side}", (rank - middle).alias(f"r{side}"))

    ranked = (
        pairs.join(ranks("a"), F.col("a") == F.col("va"))
        .join(ranks("b"), F.col("b") == F.col("vb"))
    )
    w, ra, rb = F.col("w"), F.col("ra"), F.col("rb")
    spread = F.sqrt(F.sum(w * ra * ra)) * F.sqrt(F.sum(w * rb * rb))
    r = F.try_divide(F.sum(w * ra * rb), spread)
    return ranked.agg(_guarded(F.coalesce(F.sum(w), F.lit(0)), r, name))


def concordant_weight(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w[p] * w[q] over all pairs with x[q] < x[p] and y[q] < y[p].

    For each bit of the rank of x, from the highest, the pairs whose ranks first differ in that
    bit are counted by one running sum in the order of y.
    """
    if len(x) < 2:
        return 0.0
    x = np.unique(x, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((-x, y))  # equal y: larger x first, so that it sees no equal y before it
    x, w = x[order], w[order].astype(np.int64)
    total = 0.0
    for bit in reversed(range(int(x.max()).bit_length())):
        node = x >> (bit + 1)
        upper = (x >> bit) & 1
        lower_sum = np.cumsum(np.where(upper == 0, w, 0))
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        before = np.r_[0, lower_sum][starts]
        inside = lower_sum - np.repeat(before, np.diff(np.r_[starts, len(x)]))
        total += float(np.sum((w * inside.astype(np.float64))[upper == 1]))
        step = np.argsort(x >> bit, kind="stable")
        x, w = x[step], w[step]
    return total


def _count_blocks(df: DataFrame, block: Column, x: str, y: str) -> float:
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        found = concordant_weight(*(frame[c].to_numpy() for c in ("x", "y", "w")))
        return pd.DataFrame({"c": [found]})

    blocks = df.select(block.alias("block"), F.col(x).alias("x"), F.col(y).alias("y"), "w")
    return blocks.groupBy("block").applyInPandas(count, "c double").agg(F.sum("c")).first()[0] or 0.0


def _concordant(points: DataFrame, rows: int, block_rows: int) -> float:
    """The same sum for a table (x, y, w) with distinct (x, y), in blocks of ``block_rows`` rows.

    Both orders get a position without ties: by (x, y descending) and by (y, x descending). A
    pair counts exactly when both positions grow. Cutting the positions into equal blocks leaves
    three kinds of pairs: same y block; same x block but a later y block; and both blocks later.
    The first two are counted block by block, the third on the grid of block totals, which is a
    smaller table of the same form: blocks of at least four times the root of the row count
    leave at most one grid cell for every sixteen rows.
    """
    if rows <= block_rows:
        return _count_blocks(points, F.lit(0), "x", "y")
    size = max(block_rows, 4 * math.isqrt(rows))
    by_x = global_row_index(points, ["x", ("y", "desc")], "px")
    placed = global_row_index(by_x, ["y", ("x", "desc")], "py")
    placed = placed.select(
        "px", "py", "w",
        F.floor(F.col("px") / size).alias("bx"), F.floor(F.col("py") / size).alias("by"),
    )
    placed = write_out(placed, "kendall")
    same_y = _count_blocks(placed, F.col("by"), "px", "py")
    same_x = _count_blocks(placed, F.col("bx"), "px", "by")
    grid = write_out(
        placed.groupBy(F.col("bx").alias("x"), F.col("by").alias("y")).agg(F.sum("w").alias("w")),
        "kendall-grid",
    )
    return same_y + same_x + _concordant(grid, grid.count(), block_rows)


def corr_kendall(
    df: DataFrame, a: str, b: str, name: str = "result", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Kendall tau-b without comparing all pairs of rows."""
    points = _pairs(df, a, b).groupBy(F.col("a").alias("x"), F.col("b").alias("y"))
    points = write_out(points.agg(F.count("*").alias("w")), "kendall-pairs")
    rows = points.count()

    def tied(*keys: str) -> float:
        sizes = points.groupBy(*keys).agg(F.sum("w").cast("double").alias("n")) if keys else points.agg(
            F.sum("w").cast("double").alias("n")
        )
        return sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0

    everything, ties_a, ties_b, ties_both = tied(), tied("x"), tied("y"), tied("x", "y")
    spread = (everything - ties_a) * (everything - ties_b)
    if everything < 1:
        tau = 0.0
    elif spread == 0:
        tau = None
    else:
        agree = _concordant(points, rows, block_rows)
        differ = everything - ties_a - ties_b + ties_both - agree
        tau = (agree - differ) / math.sqrt(spread)
    return df.sparkSession.range(1).select(F.lit(tau).cast("double").alias(name))


def correlate(df: DataFrame, a: str, b: str, method: str = "pearson", name: str = "result") -> DataFrame:
    methods = {"pearson": corr_pearson, "spearman": corr_spearman, "kendall": corr_kendall}
    return methods[method](df, a, b, name)
