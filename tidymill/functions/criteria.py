"""The COUNTIF/SUMIF criterion: ``">10"``, ``"!=3"``, ``"<=5"``, or a plain value for equality."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from .numbers import NUMBER_TEXT, to_number
from .refs import is_number
from .text import as_text, upper_trim

_OPERATORS = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
}


def criterion_predicate(
    c: Column, data_type: T.DataType, criterion, null_matches_ne: bool = False
) -> Column:
    """One boolean column for the criterion.

    A numeric criterion compares numbers, any other compares text without regard to case and
    outer spaces. A plain text criterion on a text column is a text test, even when it looks
    like a number. A null cell matches nothing, unless ``null_matches_ne`` is set for ``!=``.
    """
    operator, operand = "=", criterion
    if isinstance(criterion, str):
        match = re.match(r"^(>=|<=|!=|>|<)(.*)$", criterion, re.DOTALL)
        if match:
            operator, operand = match[1], match[2]
    numeric = isinstance(operand, (int, float)) and not isinstance(operand, bool)
    if isinstance(operand, str) and re.match(NUMBER_TEXT, operand.strip()):
        numeric = operator != "=" or is_number(data_type)
    if numeric:
        left, right = to_number(c, data_type), F.lit(float(operand))
    else:
        left, right = upper_trim(as_text(c, data_type)), upper_trim(F.lit(str(operand)))
    result = F.coalesce(_OPERATORS[operator](left, right), F.lit(False))
    if operator == "!=" and null_matches_ne:
        result = result | c.isNull()
    return result
