"""Records of delimited text whose quoted fields may hold line breaks, read in splits.

Whether a line begins inside a quoted field depends on all lines before it, but only through one bit:
each line, and so each split of a file, is a function from that bit to itself. The splits are read
once for their functions (one small row a split), composed in order, and read again knowing the bit
each begins with. A record that crosses a split is put together from the pieces at its borders; all
others stay where they were read.

Only runs of quotes matter to the function. An odd run closes a field if what follows ends it, opens
one if what stands before begins it, turns the bit if both, and is a plain character otherwise, so a
stray quote (``5" pipe``) changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_QUOTE, _RETURN = 34, 13
_CLOSE, _OPEN, _TURN = 0, 1, 2
WHOLE, HEAD, REST = 0, 1, 2  # a record; the start of one that the split ends in; what goes on from the split before


def events(lines: pa.BinaryArray, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, kind) of each odd run of quotes that may change the bit, in order."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
    quotes = np.flatnonzero(data[offsets[0] : offsets[-1]] == _QUOTE) + offsets[0]
    if not len(quotes):
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    line = np.searchsorted(offsets, quotes, "right") - 1
    first = np.ones(len(quotes), bool)
    first[1:] = (np.diff(quotes) > 1) | (np.diff(line) > 0)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(quotes)))
    odd = size % 2 == 1
    start, stop, line = quotes[at][odd], (quotes[at] + size)[odd], line[at][odd]
    begin, end = offsets[line], offsets[line + 1]
    before = (start == begin) | (data[np.maximum(start - 1, 0)] == separator)
    following = data[np.minimum(stop, len(data) - 1)]
    after = (stop == end) | (following == separator) | (following == _RETURN) & (stop + 1 == end)
    kind = np.where(before & after, _TURN, np.where(before, _OPEN, _CLOSE)).astype(np.int8)
    real = before | after
    return line[real], kind[real]


def states(line: np.ndarray, kind: np.ndarray, n: int, bit: int) -> np.ndarray:
    """The bit at the start of each of ``n`` lines, and at last the one after them."""
    if not len(line):
        return np.full(n + 1, bit, np.int8)
    place = np.arange(len(kind))
    fixed = np.maximum.accumulate(np.where(kind == _TURN, -1, place))
    turns = np.cumsum(kind == _TURN)
    known = np.where(fixed >= 0, kind[fixed], bit)
    since = turns - np.where(fixed >= 0, turns[fixed], 0)
    after = np.concatenate([[bit], known ^ (since & 1)]).astype(np.int8)
    return after[np.searchsorted(line, np.arange(n + 1), "left")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, line``: every line with the split it belongs to, in order within the split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.BinaryArray]]:
    """(file, start, lines) for the part of each batch that lies in one split."""
    for batch in batches:
        file, start = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for begin, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if stop > begin:
                yield int(file[begin]), int(start[begin]), batch.column(2).slice(begin, stop - begin)


def split_functions(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, start, fixed, turned``: one row per split. The bit after the split is ``fixed``, or if
    that is null the bit before it, turned if ``turned`` is 1."""
    sign = ord(separator)

    def run(batches):
        at, bits, fixed = None, (0, 1), False
        for file, start, lines in _by_split(batches):
            if at != (file, start):
                if at is not None:
                    yield _row(at, bits)
                at, bits = (file, start), (0, 1)
            line, kind = events(lines, sign)
            bits = tuple(int(states(line, kind, len(lines), bit)[-1]) for bit in bits)
        if at is not None:
            yield _row(at, bits)

    def _row(at, bits):
        same = bits[0] == bits[1]
        values = [[at[0]], [at[1]], [bits[0] if same else None], [0 if same else bits[0]]]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["file", "start", "fixed", "turned"])

    return _lines(spark, path).mapInArrow(run, "file long, start long, fixed long, turned long")


def split_bits(functions: DataFrame) -> DataFrame:
    """``file, start, inside``: whether each split begins inside a quoted field.

    Windows hold the splits of one file, not its lines."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = functions.withColumn("turns", F.sum("turned").over(Window.partitionBy("file").orderBy("start")))
    known = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(before)
    so_far = F.coalesce(F.last("turns").over(before), F.lit(0))
    bit = F.when(known.isNull(), so_far).otherwise(known["fixed"] + so_far - known["turns"])
    return turns.select("file", "start", (bit % 2 == 1).alias("inside"))


class _Split:
    """The lines of one split so far, and the record that is not complete yet."""

    def __init__(self, file: int, start: int, inside: bool):
        self.at, self.bit, self.rest = (file, start), int(inside), inside
        self.held: list[bytes] = []
        self.titled = start != 0  # the first record of a file is its header

    def add(self, lines: pa.BinaryArray, separator: int) -> Iterator[pa.RecordBatch]:
        bits = states(*events(lines, separator), len(lines), self.bit)
        self.bit = int(bits[-1])
        starts = np.flatnonzero(bits[:-1] == 0)
        if not len(starts):
            self.held += lines.to_pylist()
            return
        self.held += lines.slice(0, starts[0]).to_pylist()
        yield from self._held(WHOLE)
        offsets = pa.array(np.append(starts, len(lines)), pa.int32())
        records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), b"\n")
        whole, self.held = records.slice(0, len(records) - 1), [records[-1].as_py()]
        while len(whole) and not self.titled:
            self.titled = bool(whole[0].as_py().strip())
            whole = whole.slice(1)
        yield from self._batch(WHOLE, whole)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._held(HEAD if self.bit and not self.rest else WHOLE)

    def _held(self, kind: int) -> Iterator[pa.RecordBatch]:
        """What is held, as a piece of the given kind, or as what goes on from the split before."""
        if not self.held:
            return
        record, self.held = b"\n".join(self.held), []
        kind, self.rest = (REST if self.rest else kind), False
        title = kind != REST and not self.titled
        self.titled = self.titled or bool(record.strip())
        if kind != WHOLE or not title:
            yield from self._batch(kind, pa.array([record], pa.binary()), title)

    def _batch(self, kind: int, records: pa.BinaryArray, title: bool = False) -> Iterator[pa.RecordBatch]:
        n = len(records)
        if n:
            same = [np.full(n, v) for v in (*self.at, kind)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, same), pa.array(np.full(n, title)), records], names=["file", "start", "kind", "title", "record"]
            )


def read(spark: SparkSession, path: str, separator: str, encoding: str) -> DataFrame:
    """``record``: every record but each file's first, as text with its line breaks. Blank ones are left out."""
    sign = ord(separator)
    # One entry a split that begins inside a field; the driver keeps the list of splits anyway.
    inside = {(r["file"], r["start"]) for r in split_bits(split_functions(spark, path, separator)).where("inside").collect()}

    def run(batches):
        split = None
        for file, start, lines in _by_split(batches):
            if split is None or split.at != (file, start):
                if split is not None:
                    yield from split.close()
                split = _Split(file, start, (file, start) in inside)
            yield from split.add(lines, sign)
        if split is not None:
            yield from split.close()

    found = _lines(spark, path).mapInArrow(run, "file long, start long, kind long, title boolean, record binary")
    text = found.withColumn("record", F.decode("record", encoding) if encoding != "UTF-8" else F.col("record").cast("string"))
    # Two pieces a split at most, as its first and last; a record's pieces are in one group.
    pieces = text.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    numbered = pieces.withColumn("number", F.sum(F.when(F.col("kind") == HEAD, 1).otherwise(0)).over(order))
    crossing = numbered.groupBy("file", "number").agg(
        F.bool_or("title").alias("title"),
        F.array_sort(F.collect_list(F.struct("start", (-F.col("kind")).alias("kind"), "record"))).alias("pieces"),
    ).select("title", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))
    records = text.where(F.col("kind") == WHOLE).select("record").union(crossing.where(~F.col("title")).select("record"))
    return records.select(F.regexp_replace("record", r"\r$", "").alias("record")).where(F.trim("record") != "")
