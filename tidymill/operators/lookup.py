"""Joins and spreadsheet lookups: VLOOKUP, grouped VLOOKUP, INDEX-MATCH.

No broadcast hints: Catalyst broadcasts a side only when its size, from file statistics or as
measured after a shuffle, is under the session's threshold, and joins by sort-merge beyond it.
The reference side is reduced to one row per key before the join, so a hot key can only sit on
the table side, where the adaptive skew join splits it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refs import col, cols, dtype, order_struct, require, unused_name
from .aggregate import aggregate_by

# Names of join kinds and aggregates a step may use.
JOIN_KINDS = {
    "inner": "inner", "left": "left", "right": "right", "outer": "outer", "full": "outer",
    "left_semi": "left_semi", "left_anti": "left_anti",
}


def _equal(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = False,
    split_hot: bool = False,
) -> DataFrame:
    """Join on same-named keys; other names both sides have get the suffixes.

    A full join reads each side once. With ``split_hot`` it is put together from a left join and the
    unmatched right rows, which read both sides twice: the adaptive skew join can split a hot key in
    those two but not in a full outer join.
    """
    kind = JOIN_KINDS[how]
    keys = [on] if isinstance(on, str) else list(on)
    require(left, *keys)
    require(right, *keys)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    own = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    other = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    if kind in ("left_semi", "left_anti"):
        own, other = left, right
    names = {k: unused_name([*own.columns, *other.columns], f"__right_{k}") for k in keys}
    other = other.withColumnsRenamed(names)
    matched = [_equal(col(k), col(names[k]), null_safe) for k in keys]
    if kind in ("left_semi", "left_anti"):
        return own.join(other, matched, kind)
    extra = [c for c in other.columns if c not in names.values()]
    own_extra = [c for c in own.columns if c not in keys]
    if kind == "right":
        joined = own.join(other, matched, "right")
        key_of = {k: col(names[k]).alias(k) for k in keys}
    elif kind == "outer" and not split_hot:
        joined = own.join(other, matched, "outer")
        key_of = {k: F.coalesce(col(k), col(names[k])).alias(k) for k in keys}
    else:
        joined = own.join(other, matched, "inner" if kind == "inner" else "left")
        key_of = {k: col(k) for k in keys}
    result = joined.select(*[key_of.get(c, col(c)) for c in own.columns], *cols(extra))
    if kind != "outer" or not split_hot:
        return result
    own_keys = own.select(*cols(keys)).distinct()
    alone = other.join(own_keys, matched, "left_anti").withColumnsRenamed({v: k for k, v in names.items()})
    padded = alone.select(
        *[col(c) if c in keys else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns],
        *cols(extra),
    )
    return result.unionByName(padded)


def _default_for(value, data_type) -> Column:
    """The default as the value's type; null when it has no such form ('' for a number)."""
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(value, str):
        return F.lit(value).try_cast(data_type)
    return F.lit(value).cast(data_type)


def first_values(
    ref: DataFrame, key: str, value: str, order_by: Sequence | None, on_duplicate: str = "first"
) -> DataFrame:
    """One row ``(__key, __value)`` per key. Partial aggregation leaves one row per key and task."""
    first = F.min_by(col(value), order_struct(order_by or [value]))
    grouped = ref.where(col(key).isNotNull()).groupBy(col(key).alias("__key"))
    if on_duplicate == "first":
        return grouped.agg(first.alias("__value"))
    counted = grouped.agg(first.alias("__value"), F.count("*").alias("__n"))
    message = F.concat(F.lit(f"key occurs more than once in {key}: "), F.col("__key").cast("string"))
    checked = F.when(F.col("__n") > 1, F.raise_error(message).cast(dtype(ref, value))).otherwise(F.col("__value"))
    return counted.select("__key", checked.alias("__value"))


def vlookup(
    table: DataFrame,
    key: str,
    ref: DataFrame,
    ref_key: str,
    value: str,
    default=None,
    order_by: Sequence | None = None,
    on_duplicate: str = "first",
    null_safe: bool = False,
    name: str | None = None,
) -> DataFrame:
    """VLOOKUP: add the reference value of each key; unmatched and null values get the default.

    When a key occurs more than once the first row by ``order_by`` counts (the smallest value
    without it), so the table keeps its row count. ``on_duplicate`` may be ``"error"`` or
    ``"all"``, which repeats the table row for each match.
    """
    require(table, key)
    require(ref, ref_key, value)
    name = name or f"{value}_procv"
    if on_duplicate not in ("first", "error", "all"):
        raise ValueError(f"on_duplicate: {on_duplicate!r}")
    if on_duplicate == "all":
        found = ref.select(col(ref_key).alias("__key"), col(value).alias("__value"))
    else:
        found = first_values(ref, ref_key, value, order_by, on_duplicate)
        if null_safe:
            null_row = (
                ref.where(col(ref_key).isNull())
                .agg(F.min_by(col(value), order_struct(order_by or [value])).alias("__value"),
                     F.count("*").alias("__n"))
                .where("__n > 0")
                .select(F.lit(None).cast(dtype(ref, ref_key)).alias("__key"), "__value")
            )
            found = found.unionByName(null_row)
    joined = table.join(found, _equal(col(key), F.col("__key"), null_safe), "left")
    filled = F.coalesce(F.col("__value"), _default_for(default, dtype(ref, value)))
    return joined.withColumn(name, filled).drop("__key", "__value")


def vlookup_agg(
    table: DataFrame, key: str, ref: DataFrame, ref_key: str, value: str, func: str = "soma",
    name: str | None = None,
) -> DataFrame:
    """VLOOKUP of an aggregate of the reference by key; unmatched keys stay null."""
    require(table, key)
    found = aggregate_by(ref.where(col(ref_key).isNotNull()), [ref_key], value, func, "__value")
    found = found.withColumnRenamed(ref_key, "__key")
    joined = table.join(found, col(key) == F.col("__key"), "left")
    return joined.withColumn(name or f"{value}_{func}", F.col("__value")).drop("__key", "__value")


def index_match_column(
    df: DataFrame, returned: str, looked_up: str, search: str, order_by: Sequence, name: str | None = None
) -> DataFrame:
    """INDEX-MATCH by column: for each row the ``returned`` of the first row whose ``search`` equals
    this row's ``looked_up``. A self lookup, linear in the table."""
    return vlookup(
        df, looked_up, df, search, returned, order_by=order_by, name=name or f"{returned}_indice"
    )


def index_match_value(
    df: DataFrame, returned: str, value, search: str, order_by: Sequence, name: str | None = None
) -> DataFrame:
    """INDEX-MATCH by constant: the same looked-up value on every row, null when absent."""
    hit = df.where(col(search) == F.lit(value)).agg(
        F.min_by(col(returned), order_struct(order_by)).alias("value")
    )
    return df.withColumn(name or f"{returned}_indice", hit.scalar())
