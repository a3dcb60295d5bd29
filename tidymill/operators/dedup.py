"""Duplicate rows, by exact or normalised keys.

Each key's first row is found by a partial aggregate, never by a window over the key: a window
would move all copies of one key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refs import col, cols, dtype, is_text, order_columns, order_struct, require
from ..functions.text import lower_trim
from .copies import count_copies


def key_columns(df: DataFrame, columns: Sequence[str] | None, normalise: bool) -> list[Column]:
    names = list(columns or df.columns)
    require(df, *names)
    keys = []
    for i, c in enumerate(names):
        key = lower_trim(col(c)) if normalise and is_text(dtype(df, c)) else col(c)
        keys.append(key.alias(f"__key{i}"))
    return keys


def mark_duplicates(
    df: DataFrame, order_by: Sequence, columns: Sequence[str] | None = None,
    normalise: bool = True, name: str = "_duplicata",
) -> DataFrame:
    """Flag every row that is not the first of its key. ``order_by`` must tell all rows apart.

    The first rows are joined back on the order columns, which are spread evenly, rather than on
    the key, which may be hot.
    """
    order_names = [k for k, _ in order_columns(order_by)]
    columns = list(columns) if columns else [c for c in df.columns if c not in order_names]
    firsts = df.groupBy(*key_columns(df, columns, normalise)).agg(
        F.min(order_struct(order_by)).alias("__first")
    )
    firsts = firsts.select(
        *[value.alias(f"__order{i}") for i, value in enumerate(_order_values(firsts, len(order_names)))],
        F.lit(True).alias("__is_first"),
    )
    same = [col(o).eqNullSafe(F.col(f"__order{i}")) for i, o in enumerate(order_names)]
    joined = df.join(firsts, same, "left")
    return joined.select(*cols(df.columns), F.col("__is_first").isNull().alias(name))


def _order_values(firsts: DataFrame, n: int) -> list[Column]:
    """The order columns out of ``order_struct``, which holds (is null, value) for each."""
    fields = firsts.schema["__first"].dataType.fieldNames()
    return [F.col("__first").getField(fields[2 * i + 1]) for i in range(n)]


def _keep_one(df: DataFrame, keys: list[Column], order_by: Sequence, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    whole_row = F.struct(*cols(df.columns))
    kept = df.groupBy(*keys).agg(pick(whole_row, order_struct(order_by)).alias("__row"))
    return kept.select("__row.*")


def drop_duplicates_normalized(
    df: DataFrame, order_by: Sequence, columns: Sequence[str] | None = None
) -> DataFrame:
    """Keep the first row of each key; text keys compare trimmed and in lower case."""
    return _keep_one(df, key_columns(df, columns, True), order_by, last=False)


def drop_duplicates_exact(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence | None = None
) -> DataFrame:
    """Keep the first row of each exact key; whole equal rows need no order."""
    if not columns:
        return df.dropDuplicates()
    return _keep_one(df, key_columns(df, columns, False), order_by, last=False)


def drop_duplicates_keep_last(
    df: DataFrame, order_by: Sequence, columns: Sequence[str] | None = None
) -> DataFrame:
    return _keep_one(df, key_columns(df, columns, False), order_by, last=True)


def count_duplicate_rows(df: DataFrame, name: str = "n_duplicates") -> DataFrame:
    """How many rows repeat an earlier row in every column, as a one-row table."""
    return df.sparkSession.range(1).select(count_copies(df)[1].alias(name))
