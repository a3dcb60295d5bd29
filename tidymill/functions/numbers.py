"""Number expressions: coercion, rounding (half to even) and the Brazilian ``1.234,56`` format."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from .refs import is_float, is_number, is_text
from .text import trim_ws

# try_cast alone would read '1d' or '1f' as a number.
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _parse(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))


def to_number(c: Column, data_type: T.DataType) -> Column:
    """Coerce to double: text that is no number, and NaN, become null."""
    if is_float(data_type):
        value = c.cast("double")
        return F.when(~F.isnan(value), value)
    if is_number(data_type):
        return c.cast("double")
    if isinstance(data_type, T.BooleanType):
        return c.cast("int").cast("double")
    if is_text(data_type):
        return _parse(trim_ws(c))
    return F.lit(None).cast("double")


def text_to_number(c: Column, data_type: T.DataType) -> Column:
    """VALUE: every dot is a thousands mark and the comma the decimal mark. Numbers pass through."""
    if not is_text(data_type):
        return to_number(c, data_type)
    no_dots = F.replace(trim_ws(c), F.lit("."), F.lit(""))
    return _parse(F.replace(no_dots, F.lit(","), F.lit(".")))


def parse_br_number(c: Column, data_type: T.DataType, places: int | None = 2, marks: bool = False) -> Column:
    """``1.234,56``, ``1234,56`` and ``1234.56`` all become 1234.56.

    With ``marks``, ``R$ 1.234,56`` does as well, and ``8%`` becomes 0.08.
    """
    if is_text(data_type):
        text = F.replace(trim_ws(c), F.lit(" "), F.lit(""))
        percent = F.lit(False)
        if marks:
            percent = text.endswith("%")
            text = F.regexp_replace(F.regexp_replace(text, r"^([+-]?)R\$[\s\u00a0]*", "$1"), "%$", "")
        dot, comma = F.lit("."), F.lit(",")
        number = _parse(
            F.when(
                F.contains(text, comma) & F.contains(text, dot),
                F.replace(F.replace(text, dot, F.lit("")), comma, dot),
            )
            .when(F.contains(text, comma), F.replace(text, comma, dot))
            .otherwise(text)
        )
        if marks:
            number = F.when(percent, number / 100).otherwise(number)
    else:
        number = to_number(c, data_type)
    return number if places is None else F.bround(number, places)


def format_br_number(c: Column, data_type: T.DataType, places: int = 2) -> Column:
    """Number, or text that holds one, as ``1.234,56`` text."""
    number = parse_br_number(c, data_type, places)
    return F.translate(F.format_number(number, places), ",.", ".,")


def round_number(c: Column, data_type: T.DataType, places: int = 0) -> Column:
    return F.bround(to_number(c, data_type), places)


_MASK = re.compile(r"^(?P<before>[^{}]*)\{:(?P<comma>,?)(?:\.(?P<places>\d+)(?P<kind>[f%])|0(?P<width>\d+)d)\}(?P<after>[^{}]*)$")


def number_to_text(c: Column, data_type: T.DataType, mask: str) -> Column:
    """TEXT: format with a mask such as ``{:,.2f}``, ``{:.1%}`` or ``{:05d}``; null becomes ''."""
    match = _MASK.match(mask)
    if not match or (match["width"] and match["comma"]):
        raise ValueError(f"mask not supported: {mask!r}")
    number = to_number(c, data_type)
    if match["width"]:
        text = F.format_string(f"%0{int(match['width'])}d", number.cast("bigint"))
    else:
        scaled = number * 100 if match["kind"] == "%" else number
        text = F.format_number(scaled, int(match["places"]))
        if not match["comma"]:
            text = F.replace(text, F.lit(","), F.lit(""))
        if match["kind"] == "%":
            text = F.concat(text, F.lit("%"))
    text = F.concat(F.lit(match["before"]), text, F.lit(match["after"]))
    return F.when(number.isNull(), F.lit("")).otherwise(text)
