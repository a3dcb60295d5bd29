"""Checks before a table is published. They report and never stop anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refs import col
from .copies import count_copies
from .profile import is_unnamed


def validate_table(
    df: DataFrame, required: Sequence[str] | None = None, min_rows: int | None = None
) -> DataFrame:
    """Rows ``(rule, passed, detail)`` for the five rules; all must pass for approval.

    Rows and empty columns come out of one pass, duplicate rows from digests of the rows.
    """
    empty = F.concat_ws(
        ", ",
        *[F.when(F.max(col(c).isNotNull()) == F.lit(False), F.lit(c)) for c in df.columns],
    )
    rows, repeated = count_copies(df)
    totals = df.agg(empty.alias("empty")).select("empty", rows.alias("rows"), repeated.alias("repeated"))
    missing = ", ".join(c for c in required or [] if c not in df.columns)
    unnamed = ", ".join(c for c in df.columns if is_unnamed(c))

    def rule(name: str, passed, detail) -> Column:
        return F.struct(F.lit(name).alias("rule"), passed.alias("passed"), detail.cast("string").alias("detail"))

    rules = [
        rule("required_columns", F.lit(not missing), F.lit(missing)),
        rule("min_rows", F.col("rows") >= F.lit(min_rows or 0), F.col("rows")),
        rule("empty_columns", F.col("empty") == "", F.col("empty")),
        rule("unnamed_columns", F.lit(not unnamed), F.lit(unnamed)),
        rule("duplicate_rows", F.col("repeated") == 0, F.col("repeated")),
    ]
    return totals.select(F.inline(F.array(*rules)))


def is_approved(report: DataFrame) -> bool:
    return report.where(~F.col("passed")).isEmpty()
