"""Turns of conversations in their order, without a window over a conversation, which may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import write_out

_PLACE_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def columns(conversations: DataFrame, empty: str = "") -> DataFrame:
    """``conv_id, turn, role, text`` with ``empty`` for a null role or text; extra columns stay out of the scan."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(empty)).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(empty)).alias("text"),
    )


def in_order(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """The rows range-partitioned and sorted by ``keys``, written once, with ``part`` (the number of the
    range) and ``place`` (from 0 in it). Rows that are equal are dealt over ranges like any others.

    The write fixes the ranges, which each job would otherwise draw anew.
    """
    told_apart = df.withColumn("__copy", F.monotonically_increasing_id())
    keys = [*keys, F.col("__copy")]
    ranged = told_apart.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumn("__copy", F.monotonically_increasing_id()).select(
        *df.columns, F.shiftright("__copy", _PLACE_BITS).alias("part"),
        F.col("__copy").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"),
    )
    return write_out(placed, label)


def part_by_part(placed: DataFrame) -> DataFrame:
    """Each part whole and in its order in one task. Parts are cut evenly, whatever the keys are."""
    return placed.repartition("part").sortWithinPartitions("part", "place")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def batches_of(records: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for record in records:
        held.append(record)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(records: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records), schema)], schema=schema)
