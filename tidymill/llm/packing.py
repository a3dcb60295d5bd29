"""Best-fit decreasing packing of whole documents into sequences of a fixed length.

1. Every document is tokenized where it is read and cut into full windows and one remainder. Only
   the pieces' places, lengths and checksums go on (their ids too if asked for).
2. Pieces are dealt by a hash of all they hold and a number written with them into groups of a few
   thousand, as many groups as the table needs, so neither a source nor a long document nor rows
   without an id make a large one. The table of pieces is written once, so
   that the count which sets the number of groups and the packing see the same rows.
3. In a group, remainders are placed longest first. The leaves of a segment tree stand for the
   capacity that open windows have left, and hold how many do; the tightest open window that fits is
   the first filled leaf from the length on, found by going down the tree once.

With some thousand remainders in a group only its last windows stay partly empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import write_out
from ._arrow import map_texts
from .bpe import read_definition
from .byte_tokens import encoder

GROUP_PIECES = 8192
WINDOW = 1024
END_ID = 0
NUMBER = "__number"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class Capacities:
    """Open windows by the capacity they have left: a segment tree of counts over 0..window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, change: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, window_id: int, capacity: int) -> None:
        self.open[capacity].append(window_id)
        self._add(capacity, 1)

    def tightest(self, length: int) -> int:
        """The smallest capacity of an open window that is ``length`` at least, or -1."""
        count, node = self.count, self.size + length
        if count[node]:
            return length
        while node > 1:  # up to the first ancestor with something to its right
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece. Equal lengths keep their order."""
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        capacity = tree.tightest(length)
        if capacity < 0:
            number, capacity, used = used, window, used + 1
        else:
            number = tree.take(capacity)
        windows[i], offsets[i] = number, window - capacity
        if capacity > length:
            tree.put(number, capacity - length)
    return windows, offsets


def cut(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): each document's ids and
    ``end_id``, cut into full windows and a remainder. Null and empty texts are ``end_id`` alone."""
    definition = read_definition(path)

    def make():
        coder = encoder(definition)
        end = np.array([end_id], "<u4")

        def step(ids, texts):
            rows: list[tuple] = []
            parts = []
            for doc_id, text in zip(ids, texts):
                tokens = np.concatenate([coder.encode(text), end])
                for start in range(0, len(tokens), window):
                    piece = tokens[start : start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(tokens)))
                    if with_ids:
                        parts.append(piece.astype(np.int64))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            columns = {n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))}
            return columns | ({"ids": pa.array(parts, pa.list_(pa.int64()))} if with_ids else {})

        return step

    return map_texts(docs, PIECES + ", ids array<long>" * with_ids, make)


def pack_pieces(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; other columns pass through.

    ``pieces`` must be a written table (it is read twice). Sequence ids are unique, not consecutive.
    A column ``NUMBER`` tells equal pieces apart and is left out.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    kept = [c for c in pieces.columns if c != NUMBER]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*kept).schema]
    schema = ", ".join([*fields, "sequence_id long", "offset long"])
    names = [*kept, "sequence_id", "offset"]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        windows, offsets = best_fit_decreasing(frame["length"].to_numpy(), window)
        frame["sequence_id"] = (int(frame["__group"].iloc[0]) << 32) + windows
        frame["offset"] = offsets
        return frame[names]

    told_by = ["doc_id", "start", "ids_crc32", "doc_tokens", *({NUMBER} & set(pieces.columns))]
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*told_by), F.lit(groups))).drop(NUMBER)
    return dealt.groupBy("__group").applyInPandas(place, schema)


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and its offset there.

    Every id of every document lies in one piece. Repeated rows are packed once each, a null
    ``doc_id`` stays null, an empty table gives an empty one; other columns of ``docs`` are not read.
    """
    pieces = cut(docs, path, window, end_id, with_ids).withColumn(NUMBER, F.monotonically_increasing_id())
    return pack_pieces(write_out(pieces, "pieces"), window, group_pieces)
