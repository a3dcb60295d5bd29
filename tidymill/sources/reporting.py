"""CSV for reporting tools, and the preview of a table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.refs import col, dtype
from ..functions.text import as_text
from ..operators.columns import snake_case_columns
from ..operators.order import keep_first_n

BYTE_ORDER_MARK = "﻿"


def write_bi_csv(df: DataFrame, folder: str, base_name: str, now: datetime | None = None) -> str:
    """Write UTF-8 CSV with a byte order mark and snake_case names into a new folder.

    The folder name carries the time and an existing folder is never overwritten. Each part
    file starts with the mark, which is put in front of the first column's name.
    """
    path = f"{folder.rstrip('/')}/{base_name}_{(now or datetime.now()):%Y%m%d_%H%M}.csv"
    named = snake_case_columns(df)
    marked = named.withColumnRenamed(named.columns[0], BYTE_ORDER_MARK + named.columns[0])
    marked.write.mode("errorifexists").options(header=True, encoding="UTF-8", escape='"').csv(path)
    return path


def preview(df: DataFrame, order_by: Sequence, n: int = 50) -> DataFrame:
    """The first rows as text, a null as ''. ``df.count()`` has the total."""
    top = keep_first_n(df, n, order_by)
    return top.select(*[F.coalesce(as_text(col(c), dtype(df, c)), F.lit("")).alias(c) for c in df.columns])
