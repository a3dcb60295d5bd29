"""What a run changed: snapshots before and after, and the row counts of each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import to_number
from ..functions.refs import col, is_float
from .copies import count_copies


def source_bytes(df: DataFrame) -> DataFrame | None:
    """Total size of the files a file-based table reads, as a one-row table; else None."""
    try:
        files = df.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
        )
    except Exception:  # not a file source
        return None
    return files.groupBy("path").agg(F.max("size").alias("size")).agg(F.sum("size").alias("bytes"))


def initial_snapshot(df: DataFrame, sizes: bool = False) -> DataFrame:
    """Rows ``(metric, column, value)``: rows, columns, total nulls, duplicates, and per column its
    type and null count; with ``sizes`` also the ``bytes`` of the files that the table reads (null if it
    reads none). Nulls are counted in one pass, equal rows by their digests."""
    nulls = []
    for f in df.schema.fields:
        value = to_number(col(f.name), f.dataType) if is_float(f.dataType) else col(f.name)
        nulls.append(F.count_if(value.isNull()))
    rows, duplicates = count_copies(df)
    totals = df.agg(F.array(*nulls).alias("nulls")).select(
        "nulls", rows.alias("rows"), duplicates.alias("duplicates")
    )

    def metric(name: str, column: str | None, value) -> Column:
        return F.struct(
            F.lit(name).alias("metric"), F.lit(column).cast("string").alias("column"),
            value.cast("string").alias("value"),
        )

    total_nulls = F.aggregate("nulls", F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = [
        metric("rows", None, F.col("rows")),
        metric("columns", None, F.lit(len(df.columns))),
        metric("total_nulls", None, total_nulls),
        metric("duplicates", None, F.col("duplicates")),
    ]
    if sizes:
        size = source_bytes(df)
        rows.append(metric("bytes", None, F.lit(None) if size is None else size.scalar()))
    for i, f in enumerate(df.schema.fields):
        rows.append(metric("type", f.name, F.lit(f.dataType.simpleString())))
        rows.append(metric("nulls", f.name, F.col("nulls")[i]))
    return totals.select(F.inline(F.array(*rows)))


_COUNTS = ("rows", "columns", "total_nulls", "duplicates")


def before_after_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows ``(metric, before, after, change, change_pct)`` and the added and removed columns."""
    counted = F.col("metric").isin(*_COUNTS)

    def counts(snapshot: DataFrame, name: str) -> DataFrame:
        return snapshot.where(counted).select("metric", F.col("value").cast("bigint").alias(name))

    change = F.col("after") - F.col("before")
    numbers = counts(before, "before").join(counts(after, "after"), "metric").select(
        "metric", "before", "after", change.alias("change"),
        F.when(F.col("metric") == "rows",
               F.coalesce(F.try_divide(change * F.lit(100.0), F.col("before")), F.lit(0.0))).alias("change_pct"),
        F.lit(None).cast("string").alias("column"),
    )

    def names(snapshot: DataFrame) -> DataFrame:
        return snapshot.where("metric = 'type'").select("column")

    def listed(one: DataFrame, other: DataFrame, label: str) -> DataFrame:
        none = F.lit(None).cast("bigint")
        return one.join(other, "column", "left_anti").select(
            F.lit(label).alias("metric"), none.alias("before"), none.alias("after"), none.alias("change"),
            F.lit(None).cast("double").alias("change_pct"), "column",
        )

    added = listed(names(after), names(before), "added_column")
    removed = listed(names(before), names(after), "removed_column")
    return numbers.unionByName(added).unionByName(removed)


def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: row and column counts before and after, rows removed and their share."""
    left = before.agg(F.count("*").alias("rows_before"), F.lit(len(before.columns)).alias("columns_before"))
    rows_after = after.agg(F.count("*").alias("n")).scalar()
    removed = F.col("rows_before") - F.col("rows_after")
    return left.withColumn("rows_after", rows_after).select(
        "rows_before", "rows_after", removed.alias("rows_removed"),
        F.coalesce(F.try_divide(removed * F.lit(100.0), F.col("rows_before")), F.lit(0.0)).alias("pct_removed"),
        "columns_before", F.lit(len(after.columns)).alias("columns_after"),
    )
