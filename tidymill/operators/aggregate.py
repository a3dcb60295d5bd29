"""Grouped and whole-table aggregates; all of them combine on the map side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.criteria import criterion_predicate
from ..functions.numbers import to_number
from ..functions.refs import col, cols, dtype, is_float, is_number, order_struct, require
from .quantiles import quantiles

# Aggregate names a step may use.
FUNCTION_NAMES = {
    "soma": "sum", "media": "mean", "contagem": "count", "mediana": "median", "avg": "mean",
    "sum": "sum", "mean": "mean", "count": "count", "min": "min", "max": "max", "median": "median",
    "std": "std", "var": "var", "nunique": "nunique", "first": "first", "last": "last",
}


def _number(df: DataFrame, name: str) -> Column:
    return to_number(col(name), dtype(df, name))


def _clean(df: DataFrame, name: str) -> Column:
    """The column itself, with NaN as null, so that integers stay integers."""
    data_type = dtype(df, name)
    return to_number(col(name), data_type) if is_float(data_type) else col(name)


def aggregate_by(
    df: DataFrame, keys: Sequence[str], target: str, func: str, name: str,
    order_by: Sequence | None = None, approx: bool = False,
) -> DataFrame:
    """One aggregate per group. ``median`` and ``nunique`` stay distributed inside a hot group too."""
    require(df, *keys, target)
    kind = FUNCTION_NAMES.get(func)
    if kind is None:
        raise ValueError(f"aggregate not known: {func!r}")
    if kind == "median":
        medians = quantiles(df, [target], [0.5], keys, approx)
        groups = df.select(*cols(keys)).distinct()
        right = medians.select(*[col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col("q")[0].alias("__q"))
        same = [col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
        return groups.join(right, same, "left").select(*cols(keys), F.col("__q").alias(name))
    if kind in ("first", "last"):
        rows = df.where(col(target).isNotNull())
        pick = F.min_by if kind == "first" else F.max_by
        value = pick(F.when(col(target).isNotNull(), col(target)), F.when(col(target).isNotNull(), order_struct(order_by)))
        return df.groupBy(*cols(keys)).agg(value.alias(name))
    c = _clean(df, target)
    if kind == "sum":
        if not is_number(dtype(df, target)):
            raise ValueError(f"sum needs a number column: {target}")
        value = F.coalesce(F.sum(c), F.lit(0))
    else:
        distinct = F.approx_count_distinct if approx else F.count_distinct
        value = {
            "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
            "std": F.stddev_samp, "var": F.var_samp, "nunique": distinct,
        }[kind](c)
    return df.groupBy(*cols(keys)).agg(value.alias(name))


def group_aggregate(
    df: DataFrame, keys: str | Sequence[str], target: str, func: str = "sum",
    order_by: Sequence | None = None, drop_null_keys: bool = False, approx: bool = False,
) -> DataFrame:
    """Aggregate one column by group; the result keeps the column's name."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if target in keys:
        raise ValueError("the target cannot be a group key too")
    if drop_null_keys:
        df = df.na.drop(subset=keys)
    return aggregate_by(df, keys, target, func, target, order_by, approx)


def count_rows(df: DataFrame, condition: str | None = None) -> DataFrame:
    rows = df.filter(F.expr(condition)) if condition else df
    return rows.agg(F.count("*").alias("total"))


def column_stats(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """mean, median, min, max, sample deviation and count of the numbers in a column. ``approx`` takes
    the median from a sketch."""
    c = _number(df, column)
    median = quantiles(df, [column], [0.5], approx=approx).select(F.col("q")[0].alias("m"))
    stats = df.agg(
        F.avg(c).alias("mean"), F.min(c).alias("minimum"), F.max(c).alias("maximum"),
        F.stddev_samp(c).alias("std"), F.count(c).alias("n"),
    )
    return stats.withColumn("median", median.scalar()).select(
        "mean", "median", "minimum", "maximum", "std", "n"
    )


def count_if(
    df: DataFrame, column: str, criterion, null_matches_ne: bool = False, name: str = "result"
) -> DataFrame:
    """COUNTIF as a one-row table."""
    hit = criterion_predicate(col(column), dtype(df, column), criterion, null_matches_ne)
    return df.agg(F.count_if(hit).alias(name))


def sum_if(
    df: DataFrame, values: str, column: str, criterion, null_matches_ne: bool = False, name: str = "result"
) -> DataFrame:
    """SUMIF as a one-row table; cells that are no number count as nothing."""
    hit = criterion_predicate(col(column), dtype(df, column), criterion, null_matches_ne)
    return df.agg(F.coalesce(F.sum(F.when(hit, _number(df, values))), F.lit(0.0)).alias(name))


def col_max(df: DataFrame, column: str, name: str = "result") -> DataFrame:
    return df.agg(F.max(_number(df, column)).alias(name))


def col_min(df: DataFrame, column: str, name: str = "result") -> DataFrame:
    return df.agg(F.min(_number(df, column)).alias(name))


def col_mean(df: DataFrame, column: str, name: str = "result") -> DataFrame:
    return df.agg(F.avg(_number(df, column)).alias(name))


def col_sum(df: DataFrame, column: str, name: str = "result") -> DataFrame:
    """The sum of no numbers is 0.0."""
    return df.agg(F.coalesce(F.sum(_number(df, column)), F.lit(0.0)).alias(name))


def harmonic_mean(df: DataFrame, column: str, name: str = "result") -> DataFrame:
    """n over the sum of 1/x of the positive numbers; 0.0 when there is none."""
    x = F.when(_number(df, column) > 0, _number(df, column))
    mean = F.try_divide(F.count(x).cast("double"), F.sum(F.lit(1.0) / x))
    return df.agg(F.coalesce(mean, F.lit(0.0)).alias(name))


def counted_by_kind(df: DataFrame, columns: Sequence[str], clean=None) -> list[DataFrame]:
    """(column, value, n) of every distinct non-null value: whole numbers, doubles and all others (as
    text) apart, each in a table of its own.

    The columns become (number of the column, value) rows with one two-phase aggregate for each kind, so
    keys of numbers have a fixed size. Counting many columns by ``count_distinct`` in one aggregate would
    copy each whole row once per column.
    """
    kinds: dict[str, list[Column]] = {}
    names = F.array(*[F.lit(c) for c in columns])
    for i, c in enumerate(columns):
        value, data_type, kind = _clean(df, c), dtype(df, c), "string"
        if is_float(data_type):
            value = value + F.lit(0.0)  # -0.0 and 0.0 are one value
        if clean is None and isinstance(data_type, T.IntegralType):
            kind = "bigint"
        elif clean is None and isinstance(data_type, T.DoubleType):
            kind = "double"
        value = value.cast(kind)
        kinds.setdefault(kind, []).append(
            F.struct(F.lit(i).alias("i"), (clean(value) if clean else value).alias("value")))
    counted = []
    for pairs in kinds.values():
        long = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
        counts = long.groupBy("i", "value").agg(F.count("*").alias("n"))
        counted.append(counts.select(names[F.col("i")].alias("column"), "value", "n"))
    return counted


def distinct_values(df: DataFrame, columns: Sequence[str], clean=None) -> DataFrame:
    """(column, value, n) rows: every distinct non-null value of every column as text, with its count."""
    counted = counted_by_kind(df, columns, clean)
    return reduce(DataFrame.unionByName, [c.withColumn("value", F.col("value").cast("string")) for c in counted])


def group_count_distinct(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column, one row each."""
    columns = list(columns or df.columns)
    require(df, *columns)
    if approx:
        counts = [
            F.struct(F.lit(c).alias("column"), F.approx_count_distinct(_clean(df, c)).alias("n_distinct"))
            for c in columns
        ]
        return df.agg(F.array(*counts).alias("m")).select(F.inline("m"))
    seen = distinct_values(df, columns).groupBy("column").agg(F.count("*").alias("n_distinct"))
    names = F.array(*[F.lit(c) for c in columns])
    every = df.agg(F.count("*").alias("rows")).select(F.explode(names).alias("column"))
    return every.join(seen, "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct")
    )
