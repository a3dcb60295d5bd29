"""Date expressions: parse text by an explicit list of formats, format by strftime codes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from .refs import is_text
from .text import trim_ws

DATE_FORMATS = (
    "yyyy-M-d HH:mm:ss",
    "yyyy-M-d'T'HH:mm:ss",
    "yyyy-M-d",
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy",
    "d-M-yyyy",
    "yyyy/M/d",
)

# Strftime codes and the Spark pattern letters that mean the same.
STRFTIME_TO_SPARK = {
    "%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD",
    "%%": "%",
}


def spark_pattern(strftime: str) -> str:
    """Translate ``%d/%m/%Y`` to ``dd/MM/yyyy``; other letters are quoted."""
    pieces = []
    for token in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", strftime):
        if token.startswith("%"):
            if token not in STRFTIME_TO_SPARK:
                raise ValueError(f"date code not supported: {token}")
            pieces.append(STRFTIME_TO_SPARK[token])
        elif token[0].isalpha():
            pieces.append(f"'{token}'")
        else:
            pieces.append(token.replace("'", "''"))
    return "".join(pieces)


def _shape(pattern: str) -> tuple[str, dict[str, int]] | None:
    """A regular expression that every text of the pattern matches, and the group of each part, by its
    letter; None for other letters."""
    digits = {"yyyy": "[0-9]{4}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "H": "[0-9]{1,2}"}
    pieces, groups = [], {}
    for token in re.findall(r"'[^']*'|y+|M+|d+|H+|m+|s+|[A-Za-z]+|[^A-Za-z']+", pattern):
        if token in digits or token in ("MM", "dd", "HH", "mm", "ss"):
            pieces.append(f"({digits.get(token, '[0-9]{2}')})")
            if token[0] in groups:
                return None
            groups[token[0]] = len(groups) + 1
        elif token[0].isalpha():
            return None
        else:
            pieces.append(re.escape(token.strip("'")))
    return ("^" + "".join(pieces) + "$", groups) if "y" in groups else None


def _try(text: Column, pattern: str) -> Column:
    """Parse by one pattern to a wall-clock time, in which the session's zone has no part.

    Numeric patterns are rearranged as text and cast. Patterns with names of months or days parse to a
    date, or with a time of day through the session's zone.
    """
    shape = _shape(pattern)
    if shape is None:
        if re.search("[HhmsaS]", re.sub(r"'[^']*'", "", pattern)):
            return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
        return F.try_to_date(text, pattern).cast("timestamp_ntz")
    expression, groups = shape

    def part(letter: str, missing: str) -> Column:
        return F.regexp_extract(text, expression, groups[letter]) if letter in groups else F.lit(missing)

    date = F.concat_ws("-", part("y", "1970"), part("M", "1"), part("d", "1"))
    time = F.concat_ws(":", part("H", "0"), part("m", "0"), part("s", "0"))
    return F.when(text.rlike(expression), F.concat_ws(" ", date, time).try_cast("timestamp_ntz"))


def cast_date(c: Column, data_type: T.DataType, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Wall-clock timestamp; a text that fits none of the formats becomes null.

    The first format that fits decides: with the default ones ``03/04/2024`` is the third of April.
    """
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if not is_text(data_type):
        return F.lit(None).cast("timestamp_ntz")
    text = trim_ws(c)
    return F.coalesce(*[_try(text, f) for f in formats])


def format_dates(
    c: Column, data_type: T.DataType, output: str = "%d/%m/%Y", formats: Sequence[str] = DATE_FORMATS
) -> Column:
    return F.date_format(cast_date(c, data_type, formats), spark_pattern(output))
