"""Nulls, empty columns, value replacement, outliers and value unification."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import to_number
from ..functions.refs import col, cols, dtype, is_float, is_number, is_text, present
from ..functions.text import as_text, upper_trim
from .quantiles import quantiles


def _clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    return to_number(col(name), dtype(df, name)) if is_float(dtype(df, name)) else col(name)


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    changes = {}
    for c, value in values.items():
        if value is not None:
            changes[c] = F.coalesce(_clean(df, c).cast(dtype(df, c)), F.lit(value).cast(dtype(df, c)))
    return df.withColumns(changes) if changes else df


def fill_null_median(df: DataFrame, columns: Iterable[str], approx: bool = False) -> DataFrame:
    """Fill with the column's median. An integer column becomes a double one, so that a median
    between two values is kept. ``approx`` takes it from a sketch, in one pass."""
    names = present(df, columns)
    for c in names:
        if not is_number(dtype(df, c)):
            raise ValueError(f"median needs a number column: {c}")
    if not names:
        return df
    medians = {r["column"]: r["q"][0] for r in quantiles(df, names, [0.5], approx=approx).collect()}
    return df.withColumns(
        {c: F.coalesce(to_number(col(c), dtype(df, c)), F.lit(medians.get(c)).cast("double")) for c in names}
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent value of each column, the smallest on ties.

    Columns of one type share a pass: values are counted in a distributed aggregate, so no task
    holds all values of a column, and one row per column comes to the driver.
    """
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(dtype(df, c).simpleString(), []).append(c)
    modes: dict[str, object] = {}
    for names in by_type.values():
        pairs = [F.struct(F.lit(c).alias("column"), _clean(df, c).alias("value")) for c in names]
        long = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        best = counts.groupBy("column").agg(
            F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value"))).alias("value")
        )
        modes.update({r["column"]: r["value"] for r in best.collect()})
    return modes


def fill_null_mode(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    names = present(df, columns)
    return _fill(df, column_modes(df, names)) if names else df


def fill_null_constant(df: DataFrame, value, columns: Iterable[str] | None = None) -> DataFrame:
    """One constant for a list of columns, or a dict ``{column: constant}``.

    A constant that does not fit its column's type is an error, not a silent skip.
    """
    wanted = dict(value) if isinstance(value, Mapping) else {c: value for c in present(df, columns or df.columns)}
    wanted = {c: v for c, v in wanted.items() if c in df.columns and v is not None}
    for c, v in wanted.items():
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        if is_number(dtype(df, c)) != number or (is_text(dtype(df, c)) and not isinstance(v, str)):
            raise TypeError(f"{v!r} does not fit column {c} of type {dtype(df, c).simpleString()}")
    return _fill(df, wanted)


def fill_nulls(df: DataFrame, strategies: Mapping[str, object]) -> DataFrame:
    """Per column ``mediana``, ``moda``, ``remover_linha``, or a constant, in the given order.

    Neighbouring columns with the same strategy are done together, in one pass.
    """
    kinds = {"mediana": fill_null_median, "moda": fill_null_mode, "remover_linha": drop_null_rows}
    todo = [(c, s) for c, s in strategies.items() if c in df.columns]
    while todo:
        kind = todo[0][1] if isinstance(todo[0][1], str) and todo[0][1] in kinds else None
        batch = []
        while todo and (todo[0][1] == kind if kind else not (isinstance(todo[0][1], str) and todo[0][1] in kinds)):
            batch.append(todo.pop(0))
        df = kinds[kind](df, [c for c, _ in batch]) if kind else fill_null_constant(df, dict(batch))
    return df


def drop_null_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the rows that are null (or NaN) in any listed column."""
    names = present(df, columns)
    return df.na.drop(subset=names) if names else df


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the null count of every column, under the column's own name, and ``__rows``."""
    counts = [F.count_if(_clean(df, c).isNull()).alias(c) for c in (columns or df.columns)]
    return df.agg(F.count("*").alias("__rows"), *counts)


def drop_empty_columns(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drop columns with at least int(rows * threshold) nulls; keep all when that is zero."""
    counts = null_counts(df).first().asDict()
    limit = int(counts.pop("__rows") * threshold)
    if limit == 0:
        return df
    return df.drop(*[c for c, n in counts.items() if n >= limit])


def replace_values(
    df: DataFrame, columns: Iterable[str], mapping: Mapping | DataFrame, normalise: bool = False
) -> DataFrame:
    """Replace whole cell values by map. ``normalise`` compares trimmed and in upper case.

    A mapping too long to write down may be a table with columns ``old`` and ``new``.
    """
    names = present(df, columns)
    if isinstance(mapping, DataFrame):
        found = mapping.groupBy(F.col("old").alias("__old")).agg(F.min("new").alias("__new"), F.lit(True).alias("__hit"))
        for c in names:
            key = upper_trim(col(c)) if normalise else col(c)
            df = df.join(found, key == F.col("__old"), "left").withColumn(
                c, F.when(F.col("__hit"), F.col("__new")).otherwise(col(c))
            ).drop("__old", "__new", "__hit")
        return df
    changes = {}
    for c in names:
        data_type = dtype(df, c)
        fitting = {
            old: new for old, new in mapping.items() if isinstance(old, str) == is_text(data_type)
        }
        key = upper_trim(col(c)) if normalise and is_text(data_type) else col(c)
        value = None
        for old, new in fitting.items():
            if normalise and isinstance(old, str):
                old = old.strip().upper()
            result = F.lit(new).cast(data_type)
            value = F.when(key == F.lit(old), result) if value is None else value.when(key == F.lit(old), result)
        if value is not None:
            changes[c] = value.otherwise(col(c))
    return df.withColumns(changes) if changes else df


def iqr_limits(df: DataFrame, column: str, approx: bool = False) -> tuple[float, float] | None:
    """Lower and upper limit, one and a half interquartile ranges outside the quartiles."""
    row = quantiles(df, [column], [0.25, 0.75], approx=approx).first()
    q = row["q"] if row else None
    if not q or q[0] is None:
        return None
    margin = 1.5 * (q[1] - q[0])
    return q[0] - margin, q[1] + margin


def outliers_iqr(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """The rows outside the limits. The limits are constants in the filter, so it reaches the scan."""
    limits = iqr_limits(df, column, approx)
    if limits is None:
        return df.limit(0)
    c = col(column) if is_number(dtype(df, column)) else to_number(col(column), dtype(df, column))
    outside = (c < F.lit(limits[0])) | (c > F.lit(limits[1]))
    if is_float(dtype(df, column)):
        outside = outside & ~F.isnan(c)
    return df.filter(outside)


def resolve_variants(mapping: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """``{"RIGHT": ["wrong", ...]}`` to ``{"WRONG": "RIGHT"}``, following entries that rewrite the
    result of an earlier one."""
    steps = [(v.strip().upper(), right) for right, variants in mapping.items() for v in variants]
    resolved = {}
    for start in dict.fromkeys(v for v, _ in steps):
        current, result = start, None
        for variant, right in steps:
            if current == variant:
                current, result = right.strip().upper(), right
        resolved[start] = result
    return resolved


def unify_values(df: DataFrame, column: str, mapping: Mapping[str, Iterable[str]] | DataFrame) -> DataFrame:
    """Write the canonical value in place of its variants, compared trimmed and in upper case.

    The mapping is ``{canonical: [variants]}``, or a table with ``variant`` and ``canonical`` such
    as ``suggest_unification`` makes. Either side of the join is broadcast by its size only.
    """
    if column not in df.columns:
        return df
    if isinstance(mapping, DataFrame):
        pairs = mapping.groupBy(upper_trim(F.col("variant")).alias("__variant")).agg(
            F.min("canonical").alias("__canonical")
        )
    else:
        rows = list(resolve_variants(mapping).items())
        if not rows:
            return df
        pairs = df.sparkSession.createDataFrame(rows, "__variant string, __canonical string")
    value = as_text(col(column), dtype(df, column))
    joined = df.join(pairs, upper_trim(value) == F.col("__variant"), "left")
    return joined.withColumn(column, F.coalesce(F.col("__canonical"), value)).select(*cols(df.columns))
