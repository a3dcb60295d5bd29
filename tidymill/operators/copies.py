"""Equal rows, found by digests of a fixed size.

A table is grouped by 128 bits of each row, so what is shuffled does not grow with its width. Rows are
compared in full only where a digest occurs more than once, so two unlike rows with one digest, should
there ever be any, are still two rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.refs import col, cols, is_float, unused_name


def _hashable(kind: T.DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def digest_columns(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row, equal for rows that grouping takes for equal: one NaN, one zero,
    nulls alike. Which cells are null goes in first, as hashes pass over nulls."""
    nulls = [col(c).isNull() for c in df.columns]
    values = [
        F.when(F.isnan(col(f.name)), F.lit(float("nan"))).otherwise(col(f.name) + F.lit(0.0).cast(f.dataType))
        if is_float(f.dataType) else col(f.name)
        for f in df.schema.fields
    ]
    return [F.xxhash64(F.lit(seed), *nulls, *values) for seed in ("first", "second")]


def count_copies(
    df: DataFrame, digests=digest_columns, keep: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[Column, Column]:
    """How many rows there are, and how many of them repeat another, as two scalar columns.

    ``keep`` writes out the digests that occur twice. They are mostly few, and the size of their files
    tells Spark so: no row then is shuffled to be compared unless its digest is among them.
    """
    if not all(_hashable(f.dataType) for f in df.schema.fields):
        counts = df.groupBy(*cols(df.columns)).agg(F.count("*").alias("__n"))
        return counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).scalar(), counts.agg(
            F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).scalar()
    names = []
    for i in range(2):
        names.append(unused_name([*df.columns, *names], f"__digest{i}"))
    keyed = df.select(*cols(df.columns), *[d.alias(n) for d, n in zip(digests(df), names)])
    groups = keyed.groupBy(*names).agg(F.count("*").alias("__n"))
    repeated = groups.where("__n > 1").select(*names)
    if keep:
        repeated = keep(repeated)
    compared = keyed.join(repeated, names, "left_semi").groupBy(*names, *cols(df.columns)).agg(F.count("*").alias("__n"))
    rows = df.agg(F.count("*")).scalar()
    return rows, compared.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).scalar()
