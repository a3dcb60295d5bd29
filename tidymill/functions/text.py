"""Text expressions. A null stays null everywhere except in ``concat``."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from .refs import is_float, is_text

# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(c: Column) -> Column:
    """Strip all Unicode white space; Spark's plain ``trim`` only knows U+0020."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def upper_trim(c: Column) -> Column:
    return F.upper(trim_ws(c))


def lower_trim(c: Column) -> Column:
    return F.lower(trim_ws(c))


def as_text(c: Column, data_type: T.DataType) -> Column:
    """Cast to text; floats print as ``10000000.0`` where Spark would print ``1.0E7``."""
    if is_text(data_type):
        return c
    plain = c.cast("string")
    if not is_float(data_type):
        return plain
    digits = F.regexp_replace(plain.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    # 1.25E-4: the point moves as text, as a decimal would cut the digits past its scale
    shape = r"^(-?)([0-9])\.([0-9]+)E-4$"
    moved = [F.regexp_extract(plain, shape, k) for k in (1, 2, 3)]
    small = F.concat(moved[0], F.lit("0.000"), moved[1], F.regexp_replace(moved[2], "0+$", ""))
    size = F.abs(c)
    large = (size >= 1e7) & (size < 1e16)
    return F.when(large, digits).when((size >= 1e-4) & (size < 1e-3), small).otherwise(plain)


def left_text(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def right_text(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def mid_text(c: Column, start: int, n: int) -> Column:
    """``n`` characters from the 1-based position ``start``."""
    if start < 1:
        raise ValueError("start counts from 1")
    return F.substring(c, start, n)


def concat(columns: list[Column], separator: str = "") -> Column:
    """Join as text; a null counts as an empty text so the separators stay aligned."""
    return F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in columns])


def java_replacement(replacement: str) -> str:
    r"""Turn a ``\1`` style replacement into the ``$1`` style of Java regular expressions."""
    escaped = replacement.replace("$", r"\$")
    return re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "$" + (m[2] or m[1]), escaped)


def replace_regex(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, java_replacement(replacement))


def extract_regex(c: Column, pattern: str) -> Column:
    """First group of the first match, null when the pattern does not occur."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))
