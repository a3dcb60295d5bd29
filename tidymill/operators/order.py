"""Row positions, ranks, sorts and top-k without ever moving a table to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.refs import col, cols, dtype, order_columns, require, sort_keys, total_order, unused_name
from ..scratch import write_out
from . import selection

# A top-k keeps k rows in every task and on the driver, so it is used for small k only; beyond, the
# n-th row is found by counting.
TOP_K_LIMIT = 10_000

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _add_bases(placed: DataFrame, part: str, size, inside: str, name: str) -> DataFrame:
    """Turn positions inside the range partitions into positions in the whole table.

    The driver sees one row per partition; the starts go back as a table of that size.
    """
    sizes = placed.groupBy(part).agg(size.alias("size")).collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r[part]):
        starts.append((row[part], total))
        total += row["size"]
    spark = placed.sparkSession
    base = unused_name(placed.columns, "__base")
    bases = spark.createDataFrame(starts, f"`{part}` bigint, `{base}` bigint")
    return (
        placed.join(F.broadcast(bases), part)
        .withColumn(name, col(base) + col(inside))
        .drop(base, part, inside)
    )


def global_row_index(
    df: DataFrame, order_by: Sequence, name: str = "row_index", partitions: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in the given order; ties go by a hash of the row.

    The rows are range-partitioned and sorted by the order keys, numbered inside their
    partition, and written out once; only the partition sizes are summed up on the driver.
    The write matters: range boundaries are sampled anew by every job, so counting in one job
    and numbering in another would not fit together.
    """
    keys = total_order(df, order_by)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    part, inside = unused_name(df.columns, "__part"), unused_name(df.columns, "__inside")
    row_id = unused_name(df.columns, "__row_id")
    placed = (
        ranged.sortWithinPartitions(*keys)
        .withColumn(row_id, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(col(row_id), _POSITION_BITS))
        .withColumn(inside, col(row_id).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop(row_id)
    )
    return _add_bases(write_out(placed, "row-index"), part, F.count("*"), inside, name)


def running_total(
    df: DataFrame, order_by: Sequence, weight: str, name: str = "before", partitions: int | None = None
) -> DataFrame:
    """Add the sum of ``weight`` (whole numbers) over all rows before this one in the order.

    The order must tell the rows apart, as it does for counted values. The sums run inside each
    range partition, so the window's groups are as even as the range partitions are.
    """
    keys = sort_keys(order_by)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    part, inside = unused_name(df.columns, "__part"), unused_name(df.columns, "__inside")
    rows_before = Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn(part, F.spark_partition_id().cast("bigint")).withColumn(
        inside, F.coalesce(F.sum(col(weight)).over(rows_before), F.lit(0)).cast("bigint")
    )
    return _add_bases(write_out(placed, "running-total"), part, F.sum(col(weight)), inside, name)


def value_ranks(df: DataFrame, column: str, value: str = "value", rank: str = "rank") -> DataFrame:
    """One row per distinct value with its average rank (1-based) and its count ``n``.

    Copies are counted before anything is sorted, so a hot value is one row here.
    """
    counts = (
        df.select(col(column).alias(value)).where(col(value).isNotNull())
        .groupBy(value).agg(F.count("*").alias("n"))
    )
    placed = running_total(counts, [value], "n", "__before")
    return placed.select(
        value, "n", (F.col("__before") + (F.col("n") + 1) / F.lit(2.0)).alias(rank)
    )


def average_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Add the average rank of each value; equal values share the mean of their ranks."""
    key = unused_name(df.columns, "__value")
    ranks = value_ranks(df, column, key, name).drop("n")
    return df.join(ranks, col(column) == col(key), "left").drop(key)


def sort_rows(
    df: DataFrame, columns: Sequence[str], ascending: bool = True, ties_by: Sequence | None = None
) -> DataFrame:
    """Sort by all columns in one direction, nulls last; columns the table lacks are ignored.

    Rows that are equal there are ordered by ``ties_by``, or else by a hash of their other columns.
    """
    names = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not names:
        return df
    order_by = [(c, "asc" if ascending else "desc") for c in names]
    return df.orderBy(*total_order(df, [*order_by, *(ties_by or [])]))


def _by_position(df: DataFrame, order_by: Sequence, keep) -> DataFrame:
    position = unused_name(df.columns, "__position")
    placed = global_row_index(df, order_by, position)
    return placed.where(keep(col(position))).orderBy(col(position)).drop(position).select(*cols(df.columns))


def keep_first_n(df: DataFrame, n: int, order_by: Sequence) -> DataFrame:
    if n <= TOP_K_LIMIT:
        return df.orderBy(*total_order(df, order_by)).limit(max(n, 0))
    keys = selection.order_keys(df, order_by)
    if keys is None:
        return _by_position(df, order_by, lambda p: p < n)
    return selection.first_rows(df, keys, n).orderBy(*total_order(df, order_by))


def keep_last_n(df: DataFrame, n: int, order_by: Sequence) -> DataFrame:
    """The last ``n`` rows, in the original order."""
    if n <= TOP_K_LIMIT:
        last = df.orderBy(*total_order(df, order_by, reverse=True)).limit(max(n, 0))
        return last.orderBy(*total_order(df, order_by))
    keys = selection.order_keys(df, order_by, reverse=True)
    if keys is None:
        total = df.count()
        return _by_position(df, order_by, lambda p: p >= total - n)
    return selection.first_rows(df, keys, n).orderBy(*total_order(df, order_by))


def index_at(df: DataFrame, column: str, position: int, order_by: Sequence, name: str = "value") -> DataFrame:
    """INDEX: the value at the 1-based position as a one-row table; null when out of range."""
    names = [k for k, _ in order_columns(order_by)]
    narrow = df.select(*cols(dict.fromkeys([*names, column])))
    keys = selection.order_keys(narrow, order_by) if position > TOP_K_LIMIT else None
    if position < 1:
        found = narrow.limit(0)
    elif position <= TOP_K_LIMIT:
        found = narrow.orderBy(*total_order(narrow, order_by)).offset(position - 1).limit(1)
    elif keys is not None:
        place = selection.row_at(narrow, keys, position - 1)
        found = narrow.limit(0) if place is None else narrow.where(selection.equal(keys, place.bound)).limit(1)
    else:
        found = _by_position(narrow, order_by, lambda p: p == position - 1)
    return found.agg(F.max(col(column)).alias(name)) if isinstance(
        dtype(df, column), T.AtomicType
    ) else found.agg(F.any_value(col(column)).alias(name))


def match_positions(
    df: DataFrame, value, column: str, order_by: Sequence, first: bool = False, name: str = "position"
) -> DataFrame:
    """MATCH: the 0-based positions of the rows where the column equals the value."""
    require(df, column)
    keys = [k for k, _ in order_columns(order_by)]
    flag = unused_name(keys, "__hit")
    narrow = df.select(*cols(keys), (col(column) == F.lit(value)).alias(flag))
    hits = global_row_index(narrow, order_by, name).where(col(flag)).select(name)
    return hits.agg(F.min(name).alias(name)) if first else hits
