"""Arrow batches of documents, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

PIECE_BYTES = 2 << 20  # text handled at once; one longer document is a piece of its own
PIECE_ROWS = 4096


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batch with a bounded number of rows and of bytes in ``column``."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))
        stop = min(max(stop, start + 1), start + PIECE_ROWS, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on whole texts read; extra columns stay out of the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_texts(docs: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """``make()`` runs once per task and returns a function from a list of ids and a list of texts
    (null for null) to the columns of ``schema`` as a dict of Arrow arrays."""

    def run(batches):
        step = make()
        for batch in batches:
            for part in pieces(batch):
                columns = step(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return id_and_text(docs).mapInArrow(run, schema)


def filter_rows(docs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """The rows of ``docs`` that are kept, whole and in place. ``make()`` returns a function from a
    list of texts to a list of booleans; the text is the column ``text``."""
    at = docs.columns.index("text")

    def run(batches):
        keep = make()
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            narrow = pa.RecordBatch.from_arrays([text, pa.array(range(batch.num_rows), pa.int64())], names=["text", "i"])
            for part in pieces(narrow):
                kept = [i for i, k in zip(part.column(1).to_pylist(), keep(part.column(0).to_pylist())) if k]
                if kept:
                    yield batch.take(pa.array(kept, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def once(column) -> Column:
    """The same value, but an expression that Catalyst does not copy into others. A filter or a
    projection above would otherwise put it into the body of a lambda, to be evaluated per element."""
    return F.when(F.spark_partition_id() >= 0, column)  # always true, and not known before the task runs
