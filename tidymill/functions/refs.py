"""Column references and type checks that every operator shares."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Reference a column by its exact name, even when it holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def require(df: DataFrame, *names: str) -> None:
    """Fail while the plan is built, not at the action, when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The given names that the table has, in the given order and once each."""
    return [n for n in dict.fromkeys(names) if n in df.columns]


def dtype(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def order_columns(order_by: Sequence) -> list[tuple[str, bool]]:
    """Normalise ``["a", ("b", "desc")]`` to ``[("a", True), ("b", False)]``."""
    if isinstance(order_by, str):
        order_by = [order_by]
    keys = []
    for item in order_by or []:
        name, direction = (item, "asc") if isinstance(item, str) else item
        keys.append((name, str(direction).lower() != "desc"))
    if not keys:
        raise ValueError("order_by is needed: Spark rows have no position of their own")
    return keys


def sort_keys(order_by: Sequence, reverse: bool = False) -> list[Column]:
    """Sort columns with nulls last in both directions; ``reverse`` is the exact opposite order."""
    keys = []
    for name, ascending in order_columns(order_by):
        c = col(name)
        if not reverse:
            keys.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
        else:
            keys.append(c.desc_nulls_first() if ascending else c.asc_nulls_first())
    return keys


def tie_break(df: DataFrame, named: Iterable[str]) -> Column | None:
    """A hash of all columns not ``named``, to order rows that the named ones leave equal.

    It makes positions repeatable and lets a range shuffle split a value that many rows share.
    A hash, because range boundaries are sampled on the driver and the columns may hold long text.
    """
    named = set(named)
    rest = [f.name for f in df.schema.fields if f.name not in named and not _holds_map(f.dataType)]
    return F.xxhash64(*cols(rest)) if rest else None


def _holds_map(data_type: T.DataType) -> bool:
    return "map<" in data_type.simpleString() or "variant" in data_type.simpleString()


def total_order(df: DataFrame, order_by: Sequence, reverse: bool = False) -> list[Column]:
    """The sort keys with a tie-break, or the exact opposite order."""
    names = [name for name, _ in order_columns(order_by)]
    require(df, *names)
    keys, ties = sort_keys(order_by, reverse), tie_break(df, names)
    if ties is not None:
        keys.append(ties.desc() if reverse else ties.asc())
    return keys


def order_struct(order_by: Sequence) -> Column:
    """The order keys as one comparable value, for ``min_by`` and ``max_by`` (ascending only)."""
    keys = order_columns(order_by)
    if not all(ascending for _, ascending in keys):
        raise ValueError("this operator takes ascending order keys only")
    parts = []
    for name, _ in keys:
        parts += [col(name).isNull(), col(name)]
    return F.struct(*parts)


def unused_name(taken: Iterable[str], base: str) -> str:
    taken = {t.lower() for t in taken}
    while base.lower() in taken:
        base += "_"
    return base
