"""Add, rename, drop and reorder columns; filter rows; IF; row-local text and number columns."""

from __future__ import annotations

import unicodedata
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import criteria, dates, numbers, text
from ..functions.refs import col, cols, dtype, present, unused_name


def put(df: DataFrame, name: str, column: Column) -> DataFrame:
    return df.withColumns({name: column})


def add_constant_column(df: DataFrame, name: str, value="") -> DataFrame:
    return put(df, name, F.lit(value))


def add_expression_column(
    df: DataFrame, name: str, expression: str, aggregates: Mapping[str, str] | None = None
) -> DataFrame:
    """A column from a SQL expression over the other columns.

    Whole-column values (``avg(x)``) go in ``aggregates``: they are computed by one aggregate
    and reach the expression as constants, by name. ``over ()`` would move every row to one
    task, so it is refused.
    """
    if re.search(r"\bover\s*\(", expression, re.IGNORECASE):
        raise ValueError("window clauses are not allowed here; use aggregates={name: sql}")
    if not aggregates:
        return put(df, name, F.expr(expression))
    clash = [a for a in aggregates if a in df.columns]
    if clash:
        raise ValueError(f"aggregate names hide columns: {clash}")
    one_row = df.agg(F.struct(*[F.expr(sql).alias(a) for a, sql in aggregates.items()]).alias("s"))
    holder = unused_name(df.columns, "__aggregates")
    with_values = df.withColumn(holder, one_row.scalar())
    with_values = with_values.withColumns({a: col(holder).getField(a) for a in aggregates})
    return put(with_values, name, F.expr(expression)).drop(holder, *aggregates)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names the table lacks are ignored."""
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*present(df, columns))


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The given columns first, all others after them in place."""
    first = present(df, order)
    return df.select(*cols(first + [c for c in df.columns if c not in first]))


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def snake_case(name: str) -> str:
    ascii_name = unicodedata.normalize("NFKD", str(name).strip()).encode("ascii", "ignore").decode()
    kept = "".join(ch for ch in ascii_name if ch.isalnum() or ch == "_" or ch.isspace())
    return "_".join(re.split(r"\s+", kept)).lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    names = [snake_case(c) for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"columns would get the same name: {doubled}")
    return df.toDF(*names)


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Keep the rows where the SQL condition is true."""
    return df.filter(F.expr(condition))


filter_sql = filter_rows


def filter_criterion(df: DataFrame, column: str, criterion, null_matches_ne: bool = False) -> DataFrame:
    """Keep the rows whose cell meets a COUNTIF criterion."""
    return df.filter(
        criteria.criterion_predicate(col(column), dtype(df, column), criterion, null_matches_ne)
    )


def if_else(df: DataFrame, condition: str, if_true, if_false, name: str = "resultado_se") -> DataFrame:
    """IF: a null condition takes the else branch; mixed branch types both become text."""
    if type(if_true) is not type(if_false) and not (
        isinstance(if_true, (int, float)) and isinstance(if_false, (int, float))
    ):
        if_true = None if if_true is None else str(if_true)
        if_false = None if if_false is None else str(if_false)
    return put(df, name, F.when(F.expr(condition), F.lit(if_true)).otherwise(F.lit(if_false)))


def _text(df: DataFrame, column: str) -> Column:
    return text.as_text(col(column), dtype(df, column))


def left_text(df: DataFrame, column: str, n: int, name: str | None = None) -> DataFrame:
    return put(df, name or f"{column}_esquerda", text.left_text(_text(df, column), n))


def right_text(df: DataFrame, column: str, n: int, name: str | None = None) -> DataFrame:
    return put(df, name or f"{column}_direita", text.right_text(_text(df, column), n))


def mid_text(df: DataFrame, column: str, start: int, n: int, name: str | None = None) -> DataFrame:
    return put(df, name or f"{column}_meio", text.mid_text(_text(df, column), start, n))


def text_length(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return put(df, name or f"{column}_tamanho", F.char_length(_text(df, column)))


def substitute_text(df: DataFrame, column: str, old: str, new: str, name: str | None = None) -> DataFrame:
    replaced = F.replace(_text(df, column), F.lit(old), F.lit(new))
    return put(df, name or f"{column}_substituido", replaced)


def concat_columns(
    df: DataFrame, columns: Sequence[str], separator: str = "", name: str = "concat"
) -> DataFrame:
    return put(df, name, text.concat([_text(df, c) for c in present(df, columns)], separator))


def text_to_number(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return put(df, name or column, numbers.text_to_number(col(column), dtype(df, column)))


def number_to_text(df: DataFrame, column: str, mask: str, name: str | None = None) -> DataFrame:
    return put(
        df, name or f"{column}_formatado", numbers.number_to_text(col(column), dtype(df, column), mask)
    )


def round_number(df: DataFrame, column: str, places: int = 0, name: str | None = None) -> DataFrame:
    rounded = numbers.round_number(col(column), dtype(df, column), places)
    return put(df, name or f"{column}_arred", rounded)


def _each(df: DataFrame, columns: Iterable[str], make) -> DataFrame:
    """Rewrite the listed columns in place in one projection; missing names are skipped."""
    changes = {c: make(col(c), dtype(df, c)) for c in present(df, columns)}
    return df.withColumns(changes) if changes else df


def round_columns(df: DataFrame, columns: Iterable[str], places: int = 2) -> DataFrame:
    return _each(df, columns, lambda c, t: numbers.round_number(c, t, places))


def upper_trim_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _each(df, columns, lambda c, t: text.upper_trim(text.as_text(c, t)))


def lower_trim_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _each(df, columns, lambda c, t: text.lower_trim(text.as_text(c, t)))


def replace_regex(df: DataFrame, columns: Iterable[str], pattern: str, replacement: str) -> DataFrame:
    return _each(df, columns, lambda c, t: text.replace_regex(text.as_text(c, t), pattern, replacement))


def extract_regex(
    df: DataFrame, columns: Iterable[str], pattern: str, name: str | None = None
) -> DataFrame:
    for c in present(df, columns):
        df = put(df, name or f"{c}_extraido", text.extract_regex(_text(df, c), pattern))
    return df


def cast_number(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _each(df, columns, numbers.to_number)


def cast_date(df: DataFrame, columns: Iterable[str], formats=dates.DATE_FORMATS) -> DataFrame:
    return _each(df, columns, lambda c, t: dates.cast_date(c, t, formats))


def cast_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _each(df, columns, text.as_text)


# The type words a step may use.
_CASTS = {
    "numero": numbers.to_number, "number": numbers.to_number,
    "data": dates.cast_date, "date": dates.cast_date,
    "texto": text.as_text, "text": text.as_text,
}


def _casts(df: DataFrame, types: Mapping[str, str]) -> dict[str, Column]:
    unknown = sorted(set(types.values()) - set(_CASTS))
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return {c: _CASTS[types[c]](col(c), dtype(df, c)) for c in present(df, types)}


def cast_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast many columns at once: ``numero``, ``data`` or ``texto`` (or the English words)."""
    return df.withColumns(_casts(df, types))


def invalid_counts(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per column, how many cells that hold a value a cast would turn into null."""
    counts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(col(c).isNotNull() & cast.isNull()).alias("n_invalid"),
        )
        for c, cast in _casts(df, types).items()
    ]
    return df.agg(F.array(*counts).alias("m")).select(F.inline("m"))


def format_dates(
    df: DataFrame, columns: Iterable[str], output: str = "%d/%m/%Y", formats=dates.DATE_FORMATS
) -> DataFrame:
    return _each(df, columns, lambda c, t: dates.format_dates(c, t, output, formats))


def parse_br_number(df: DataFrame, columns: Iterable[str], places: int = 2, marks: bool = False) -> DataFrame:
    return _each(df, columns, lambda c, t: numbers.parse_br_number(c, t, places, marks))


def format_br_number(df: DataFrame, columns: Iterable[str], places: int = 2) -> DataFrame:
    return _each(df, columns, lambda c, t: numbers.format_br_number(c, t, places))
